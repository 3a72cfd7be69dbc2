"""python -m thermolith COMMAND FOLDER: generate, mini, single, robustness, compare, report, coordination, thermal, events, degradation, inspect or check."""

import sys

from .operators.store import RunStore
from .plans import experiments
from .session import session
from .sources import signals

#: Reports over a store: each gives one or more tables to show.
REPORTS = {
    "compare": experiments.compare, "report": lambda s: (experiments.compare_lines(s),), "coordination": lambda s: (experiments.coordination(s),), "thermal": experiments.thermal,
    "events": lambda s: (experiments.events(s),), "degradation": lambda s: (experiments.degradation(s),), "inspect": experiments.inspect,
}
COMMANDS = ("generate", "mini", "single", "robustness", "check", *REPORTS)


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    command, folder, *rest = args
    spark = session()
    if command == "generate":
        signals.write_csv(signals.generate(spark).drop("step_index"), folder)
    elif command == "mini":
        experiments.mini(spark, folder).show(truncate=False)
    elif command == "single":
        print("runs:", experiments.single_center(spark, folder))
    elif command == "robustness":
        print("runs:", experiments.robustness(spark, folder, rest or None))
    elif command == "check":  # the environment: versions, and that a job runs
        print("python", sys.version.split()[0], "spark", spark.version, "sum", spark.range(10).groupBy().sum("id").first()[0])
    else:
        for df in REPORTS[command](RunStore(spark, folder).initialize()):
            df.show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
