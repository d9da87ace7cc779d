"""Registered queries: each with the Spark program and, where SQL can say it, its SQL."""
