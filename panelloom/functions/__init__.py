from panelloom.functions import moments, samples, scalar

__all__ = ["moments", "samples", "scalar"]
