"""Entity-period panels and probabilistic forecast scoring on Spark.

The package is organised by what a user does with a panel:

``sources``    read and write tables, reshape wide layouts, hold crosswalks
``functions``  column expressions (no DataFrame in, no DataFrame out)
``operators``  ``DataFrame -> DataFrame`` building blocks
``plans``      complete lifecycles put together from the operators
"""

from panelloom.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
