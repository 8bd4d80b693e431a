"""Plan building blocks shared by the operators: skew, exact ranks, ordered scans, scratch space."""
