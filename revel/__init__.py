"""revel — review and explanation analytics as Spark jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``); column helpers live in ``revel.functions``; readers and
writers in ``revel.sources``; composite jobs in ``revel.plans``.
"""

from revel.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
