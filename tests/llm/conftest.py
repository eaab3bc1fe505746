import pytest


@pytest.fixture(autouse=True)
def _settings(spark):
    """The entry point's own session settings."""
    from trialgrid.session import apply_required_conf
    apply_required_conf(spark)
