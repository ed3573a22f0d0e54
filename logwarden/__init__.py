"""logwarden: login-risk analytics as Spark DataFrame operators."""
