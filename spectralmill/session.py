"""Session settings that the operators rely on; anything already set is left alone."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "spectralmill", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | settings
    spark = builder.config(map=defaults).getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = Path(__file__).resolve().parent
    if home.parent.suffix == ".zip":  # already runs from a shipped copy
        return
    target = Path(tempfile.mkdtemp(prefix="spectralmill-")) / "spectralmill-package.zip"
    with zipfile.ZipFile(target, "w") as package:
        for file in sorted(home.rglob("*.py")):
            package.write(file, file.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
