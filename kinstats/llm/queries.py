"""All queries of this subpackage, and the SQL of those that SQL can express."""

from importlib import import_module

MODULES = ["q_quality", "q_lsa", "q_langid", "q_runindex", "q_lmscore", "q_debruijn", "q_packing", "q_simhash", "q_urlrules", "q_warc", "q_runs", "q_contentsort", "q_align"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
