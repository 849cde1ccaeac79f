"""All modules of queries; importing this fills the registry."""

from factloom.plans import lookups, parsing, programs, reference  # noqa: F401
