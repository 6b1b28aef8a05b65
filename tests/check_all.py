"""Command-line check: python tests/check_all.py <sf dir> [query names or @modules]."""

import sys

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from oracle import compare, connect  # noqa: E402

from panelloom.session import build_session  # noqa: E402
from workload import base  # noqa: E402

sf = sys.argv[1]
wanted = sys.argv[2:]
mods = [w[1:] for w in wanted if w.startswith("@")]
names = [w for w in wanted if not w.startswith("@")]
registry = base.load_all()
spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
failed = []
for name, q in registry.items():
    if (names or mods) and name not in names and q.module not in mods:
        continue
    try:
        problems, info = compare(spark, con, q, sf)
    except Exception as e:  # noqa: BLE001
        problems, info = [f"{type(e).__name__}: {str(e)[:700]}"], {}
    status = "ok  " if not problems else "FAIL"
    print(status, name, {k: round(v, 2) for k, v in info.items()}, "" if q.sql else "(no sql)", *problems, flush=True)
    if problems:
        failed.append(name)
    spark.catalog.clearCache()
print("failed:", failed)
