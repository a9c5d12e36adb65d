"""Print the SURVEY §2 operator → query coverage table from the catalog descriptions."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ternlens.plans import catalog  # noqa: E402


def main():
    q = catalog.queries()
    o = catalog.oracle_sql()
    by_op: dict[str, list[str]] = {}
    for name in q:
        for op in re.findall(r"\b([A-Z]{1,2}\d{1,2})\b", catalog.DESCRIPTIONS.get(name, "")):
            by_op.setdefault(op, []).append(name)
    order = lambda k: (re.match(r"[A-Z]+", k).group(0), int(re.search(r"\d+", k).group(0)))
    print("| Operator | Queries (✓ = DuckDB oracle, R = rows-only) |")
    print("|---|---|")
    for op in sorted(by_op, key=order):
        names = ", ".join(f"`{n}` {'✓' if n in o else 'R'}" for n in sorted(set(by_op[op])))
        print(f"| {op} | {names} |")


if __name__ == "__main__":
    main()
