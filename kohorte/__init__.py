"""Subscription analytics as Spark DataFrame operators.

Every operator takes a mapping of logical table name -> DataFrame plus a
:class:`~kohorte.params.Params` and returns a lazy DataFrame.
"""

from kohorte.params import Params
from kohorte.session import build_session, configure

__all__ = ["Params", "build_session", "configure"]
