"""python -m tidemill convert CSV SCHEMA OUT | export IN CSV | query IN ID CSV"""

from __future__ import annotations

import sys

from .plans.clickbench import build_query
from .session import session
from .sources.columnar import convert, export, read_columnar
from .sources.csv_files import write_csv_file


def query_number(text: str) -> int:
    if not text.isascii() or not text.lstrip("-").isdigit():
        raise ValueError(f"Invalid query id: {text}")
    return int(text)


def main(args: list[str]) -> int:
    match args:
        case ["convert", source, schema, out]:
            run = lambda spark: convert(spark, source, schema, out)
        case ["export", source, out]:
            run = lambda spark: export(spark, source, out)
        case ["query", source, number, out]:
            run = lambda spark: write_csv_file(build_query(read_columnar(spark, source), query_number(number)), out)
        case _:
            print(__doc__, file=sys.stderr)
            return 1
    try:
        run(session())
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0
