"""Compare all (or the named) queries with their SQL twins: ``python tests/check_all.py FOLDER [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import REGISTRY  # noqa: E402
from catalog.tables import Tables  # noqa: E402
from tallyweir.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        query = REGISTRY[name]
        start = time.time()
        try:
            df = query.run(Tables(spark, folder))
            problems = compare(df, con, query.sql) if query.sql else ([] if df.collect() else ["no rows"])
        except Exception as error:  # noqa: BLE001
            problems = [str(error)[:600] if os.environ.get("BRIEF") else traceback.format_exc()[-1500:]]
        mark = "ok " if not problems else "BAD"
        bad += bool(problems)
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if query.sql else ' (rows only)'}", flush=True)
        for p in problems:
            print("    ", p[:1200], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
