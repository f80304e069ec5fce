"""tableproof: profile, propose, decide and apply table corrections on Spark."""

__version__ = "0.1.0"
