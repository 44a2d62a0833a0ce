"""Session factory and the settings every plan of this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle: int = 8, app: str = "quillbar", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on. Extra settings are given as
    keyword arguments, dots written as double underscores."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset and everything runs on one machine (tests), a folder in the warehouse;
    on a cluster a machine's own folder would be lost with it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut_lineage(df, eager: bool = True):
    """Writes a frame to the reliable checkpoint folder and reads it back.
    Executors may be lost afterwards: the files are shared."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers once per application, so that they need
    not have it installed. The driver's file server hands out the archive."""
    import tempfile
    import zipfile
    from pathlib import Path

    home = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not home.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="quillbar-")) / "quillbar_ship.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, Path(home.name) / p.relative_to(home))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()
