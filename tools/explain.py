"""Print the formatted physical plan of registered queries over the stored
(materialised) inputs - how they would read a deployment's tables.

    python tools/explain.py [--sf DIR] [--no-broadcast] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.plans import catalog  # noqa: E402
from strata.session import local_session  # noqa: E402
from strata.sources import fixtures as fx  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--no-broadcast", action="store_true", help="plan as for tables above any broadcast threshold")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    spark = local_session(8, shuffle_partitions=16)
    if a.no_broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    fx.materialize(spark, a.sf)
    for name in a.names:
        print(f"===== {name}")
        catalog.QUERIES[name](spark, a.sf).explain("formatted")


if __name__ == "__main__":
    main()
