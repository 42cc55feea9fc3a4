"""Image and time-lapse analytics as Spark DataFrame operators: images, objects and region graphs are tables."""
