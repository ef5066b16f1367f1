"""Sources, sampling and providers of recorded answers."""
