import tempfile

import pytest


@pytest.fixture(scope="session")
def spark():
    from rivulet.session import session

    conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "6", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    s = session("tests", **conf, **{"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
