"""The task registry and the jobs composed from the operators."""
