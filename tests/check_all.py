"""Run the named queries against their SQL: ``python tests/check_all.py [--distributed] [folder] [name ...]``.

``--distributed`` sets the small-table bounds to zero, so that every operator takes the way it takes at scale.
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from plumbline.session import BROADCAST_BYTES_CONF, SMALL_ROWS_CONF, local_session  # noqa: E402


def main() -> None:
    arguments = [a for a in sys.argv[1:] if a != "--distributed"]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    only = arguments[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if "--distributed" in sys.argv:
        spark.conf.set(SMALL_ROWS_CONF, "0")
        spark.conf.set(BROADCAST_BYTES_CONF, "0")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in sql:
                problem = compare(con, frame, sql[name])
                state = "ok" if problem is None else f"DIFF {problem[:900]}"
            else:
                state = f"rows {len(frame.collect())} (no SQL)"
        except Exception as error:
            state = f"ERROR {type(error).__name__} {str(error)[:900]}"
            if only:
                traceback.print_exc()
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {state}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
