"""Command line: compare registered queries with their SQL twins.

    python tests/check.py [sf_dir] [name-substring ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberscan.session import local_session  # noqa: E402
from tests.oracle import compare, connection  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    import __spark_entry__ as entry

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connection(sf), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = build(spark, sf)
            if name in sqls:
                diff, kind = compare(df, con, sqls[name]), "sql"
            else:
                n = df.count()
                diff, kind = ([] if n else ["no rows"]), f"rows={n}"
        except Exception as err:  # noqa: BLE001
            diff, kind = [f"{type(err).__name__}: {str(err)[:1500]}"], "error"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} [{kind}] {time.time() - t0:.1f}s", flush=True)
        for line in diff:
            print("     ", line, flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
