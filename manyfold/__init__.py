"""manyfold: many structurally identical tables read as one, planned and run by Spark."""
