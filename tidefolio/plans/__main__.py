"""Command line: ``spark-submit --py-files tidefolio.zip tidefolio/plans/__main__.py JOB --base FOLDER``."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from tidefolio.operators import layout
from tidefolio.plans import portfolio, quality, realtime, reconciliation, rewards
from tidefolio.plans.lake import Lake
from tidefolio.session import TASK_BYTES, session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidefolio")
    parser.add_argument("job", choices=["portfolio", "rewards", "quality", "reconciliation", "realtime", "compact", "fold"])
    parser.add_argument("--base", required=True, help="folder with raw/, warehouse/ and so on")
    parser.add_argument("--incremental", action="store_true", help="portfolio: new days only")
    parser.add_argument("--since", help="first day to compute again")
    parser.add_argument("--realtime-log", help="reconciliation: log of position changes, if not the lake's own")
    parser.add_argument("--as-of", help="quality: day on which tables should be fresh (default: today)")
    parser.add_argument("--publish-to", help="realtime: Kafka servers that get the views that append")
    parser.add_argument("--derive", action="store_true", help="quality: derive both fact tables again and compare every row")
    parser.add_argument("--limit", type=int, default=TASK_BYTES, help="compact: size in bytes that files should have")
    parser.add_argument("--every", help="realtime: keep running, with this trigger interval")
    given = parser.parse_args(arguments)
    spark = session(f"tidefolio {given.job}")
    try:
        if given.job == "portfolio":
            print(portfolio.run(spark, given.base, given.incremental or given.since is not None, given.since))
        elif given.job == "rewards":
            print(rewards.run(spark, given.base, since=given.since))
        elif given.job == "quality":
            print(quality.run(spark, given.base, as_of=given.as_of or str(date.today()), derive=given.derive))
        elif given.job == "fold":
            print(realtime.fold(spark, given.base))
        elif given.job == "compact":
            for path in Lake(given.base).dated_tables():
                print(path, layout.compact_small(spark, path, given.limit))
        elif given.job == "realtime":
            realtime.run(spark, given.base, given.every, given.publish_to)
            if given.every:
                spark.streams.awaitAnyTermination()
        else:
            reconciliation.run(spark, given.base, given.realtime_log)
    except quality.QualityError as failure:
        print(failure, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
