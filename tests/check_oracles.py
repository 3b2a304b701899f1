"""Command line: python tests/check_oracles.py [folder] [name ...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from valsieve.session import local_session  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(8), connect(folder)
    failed = 0
    for name in names:
        try:
            problem, rows, seconds = compare(spark, con, folder, name, queries, oracles)
        except Exception as exc:
            problem, rows, seconds = f"{type(exc).__name__}: {str(exc)[:1500]}", -1, -1
        failed += problem is not None
        mark = "" if name in oracles else " (no sql)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{mark} rows={rows} {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main()
