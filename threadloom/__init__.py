"""threadloom: conversation analytics for workplace chat, written as Spark jobs."""
