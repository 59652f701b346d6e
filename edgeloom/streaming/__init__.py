"""No operator of this library works on streams; edge lists are bounded tables."""
