"""Developer loop: ``python tests/check.py [name prefix ...] [--sf 0.001]`` prints time and difference per query."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from joulemill.registry import load  # noqa: E402
from joulemill.session import local_session  # noqa: E402
from tests.harness import difference, duck, duck_table, spark_table  # noqa: E402


def main(args):
    sf = "0.001"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        args = args[:at] + args[at + 2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(folder)
    bad = 0
    for name, q in load().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            got = spark_table(q(spark, folder))
            took = time.time() - start
            note = "rows only"
            if q.sql:
                t1 = time.time()
                note = difference(got, duck_table(con, q.sql))
                duck_took = time.time() - t1
                if duck_took > 5:
                    print(f"   slow oracle {duck_took:.1f}s")
            bad += bool(note and note != "rows only")
            print(f"{'ok  ' if not note or note == 'rows only' else 'FAIL'} {name:40s} {took:6.2f}s {len(got[2]):7d} rows {note or ''}"[:600], flush=True)
        except Exception as error:
            bad += 1
            text = str(error) if "-v" not in sys.argv else traceback.format_exc()
            print(f"FAIL {name:40s} {type(error).__name__}: {text[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if a != "-v"])
