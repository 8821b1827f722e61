"""Write the formatted physical plans of a few key queries to PLANS.md (after running them, so
the adaptive plans are final).

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.operators.load import Warehouse  # noqa: E402
from ledgerlens.operators.views import FilterState, month_scoped  # noqa: E402
from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources import read_statements  # noqa: E402

FIXTURE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests", "fixtures", "statement.csv")


def formatted(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.sub(r"file:/[^\]\s,]*", "<path>", text)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    sections = []
    for name in ["spend_by_category", "incremental_load", "code_classification"]:
        sections.append((f"registered query `{name}` ({sf_dir})", formatted(catalog.QUERIES[name](spark, sf_dir))))
    wh = Warehouse(spark, os.path.join(tempfile.mkdtemp(prefix="plans-"), "wh"))
    wh.initialise()
    wh.load_statements(read_statements(spark, FIXTURE))
    sections.append(("stored warehouse view, one month selected (partition pruning, no merchant join)",
                     formatted(month_scoped(wh.view(), FilterState(["2024-03"])))))
    with open("PLANS.md", "w") as f:
        f.write("# Physical plans of key queries\n\nGenerated by `tools/plan_report.py`; paths replaced by `<path>`.\n")
        for title, text in sections:
            f.write(f"\n## {title}\n\n```\n{text.strip()}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
