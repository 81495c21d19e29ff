from shiftlens.plans import catalog, oracles  # noqa: F401
