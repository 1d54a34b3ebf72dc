"""Registered queries of the core operators and their DuckDB statements."""

from __future__ import annotations

from newsloom.plans import core_a, core_b, core_c, core_d, core_e, core_f, core_g, core_h, core_i

QUERIES = {**core_a.QUERIES, **core_b.QUERIES, **core_c.QUERIES, **core_d.QUERIES, **core_e.QUERIES, **core_f.QUERIES, **core_g.QUERIES, **core_h.QUERIES, **core_i.QUERIES}
ORACLE = {**core_a.ORACLE, **core_b.ORACLE, **core_c.ORACLE, **core_d.ORACLE, **core_e.ORACLE, **core_f.ORACLE, **core_g.ORACLE, **core_h.ORACLE, **core_i.ORACLE}
