"""DataFrame -> DataFrame operators over the transaction model."""
