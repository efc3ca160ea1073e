import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import session

    s = session("local[2]", partitions=2, **{"spark.driver.memory": "2g", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"})
    s.sparkContext.setLogLevel("ERROR")
    return s
