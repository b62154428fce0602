"""Compare all, or the named, registered queries with their SQL and print the time each takes."""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from checking import compare, duck, SF_DIR  # noqa: E402
from teleloom.plans import ORACLES, QUERIES  # noqa: E402
from teleloom.session import local_session  # noqa: E402

names = [a for a in sys.argv[1:] if not a.startswith("--")]
spark = local_session(8)
con = duck()
bad = 0
for name in names or list(QUERIES):
    start = time.time()
    try:
        if name in ORACLES:
            problem = compare(spark, con, name, QUERIES[name], ORACLES[name])
        else:
            problem = f"(no SQL) {QUERIES[name](spark, SF_DIR).count()} rows"
    except Exception as error:
        where = traceback.extract_tb(error.__traceback__)
        places = " < ".join(f"{f.filename.split('/')[-1]}:{f.lineno}" for f in where if "/root/repo" in f.filename)
        problem = f"{type(error).__name__} {str(error)[:500]} at {places}"
    bad += bool(problem) and not problem.startswith("(no SQL)")
    print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
print("different:", bad)
