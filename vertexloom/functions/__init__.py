"""Column helpers and the small DataFrame building blocks every operator shares."""
