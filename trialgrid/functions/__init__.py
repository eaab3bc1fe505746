"""trialgrid."""
