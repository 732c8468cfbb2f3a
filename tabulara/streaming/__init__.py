"""Extensions of Spark's own making: the files of deliveries as a stream."""
