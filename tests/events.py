"""Spark's event log of the test session: the plans of every job that ran."""

import glob
import json
import re
from urllib.parse import urlparse

CONF = {"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}
PLANS = ("SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate")


class EventLog:
    """What the session's event log gains after ``EventLog(spark)``."""

    def __init__(self, spark):
        self.sc = spark.sparkContext
        folder = urlparse(self.sc.getConf().get("spark.eventLog.dir")).path
        self.path, = glob.glob(f"{folder}/{self.sc.applicationId}*")
        self._settle()
        with open(self.path, "rb") as f:
            self.start = f.seek(0, 2)

    def _settle(self):
        self.sc._jsc.sc().listenerBus().waitUntilEmpty()

    def plans(self) -> dict[int, str]:
        """The last plan (as AQE left it) of each SQL execution since then."""
        self._settle()
        out = {}
        with open(self.path, "rb") as f:
            f.seek(self.start)
            for line in f:
                if any(name.encode() in line[:200] for name in PLANS):
                    event = json.loads(line)
                    out[event["executionId"]] = event["physicalPlanDescription"]
        return out


def operators(plan: str) -> list[tuple[str, str]]:
    """(operator, arguments) of each node that a formatted plan describes."""
    out = []
    for part in re.split(r"\n\n+", plan):
        head = re.match(r"\(\d+\) (\w+)", part.strip())
        if head:
            arguments = re.search(r"^Arguments: (.*)$", part, re.M)
            out.append((head[1], arguments[1] if arguments else ""))
    return out
