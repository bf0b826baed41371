"""Spark-native analytics over a job search: e-mails, applications, event timelines and questions about them."""
