"""All queries of the network part, and their SQL."""

from . import core, further, graphs

QUERIES = {**core.QUERIES, **graphs.QUERIES, **further.QUERIES}
SQL = {**core.SQL, **graphs.SQL, **further.SQL}
