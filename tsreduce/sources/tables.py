"""Base tables: schemas, directory scans, and result sinks."""

from __future__ import annotations

import csv
import io
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each table. can_charge is read as text, as rows with 1 for true occur.
SCHEMAS = {
    "assets": "id string, location string, technology string, unit_capacity double, initial_units double",
    "assets_profiles": "asset string, profile_type string, profile string",
    "assets_storage": "id string, capacity_storage_energy double, initial_storage_units double",
    "assets_storage_seasonal": "id string, initial_storage_level double, peak_inflow double, spillage_cost double, borrow_cost double, can_charge string",
    "assets_storage_seasonal_reservoir_levels": "asset string, profile_type string, profile_name string",
    "demand": "id string, location string, carrier string, peak_demand double",
    "investments": "id string, cost double",
    "scalars": "scalar string, value double",
    "technologies": "id string, type string, carrier_out string",
    "technologies_conversion": "id string, carrier_in string, efficiency_in double, efficiency_out double",
    "technologies_generation": "id string, variable_cost double, ramping_rate double",
    "technologies_storage": "id string, is_seasonal boolean, efficiency_in double, efficiency_out double",
    "transmission_lines": "id string, `from` string, `to` string, carrier string, export_capacity double, import_capacity double",
}
RP_PROFILES = "rep_period long, timestep long, id string, profile_type string, value double"
LEVELS = "period long, timestep long, id string, value double"
GRID = "n_rep_periods long, period_length long, clustering_type string, distance string, weight_type string, niters long, learning_rate double, evaluation_type string"


def table_name(path: str) -> str:
    """The file's base name with _ for -; wide profile tables end with _raw."""
    name = re.sub(r"\.csv$", "", Path(path).name).replace("-", "_")
    return f"{name}_raw" if name.startswith("profiles") else name


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in a file's first line; none of an empty file. Only that line is read, without a job."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        java = spark._jvm.java.io
        head = java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return [n.strip().removeprefix("\ufeff") for n in next(csv.reader([head]))] if head else []


def _by_name(spark: SparkSession, paths: str | list[str], kind_of) -> DataFrame | None:
    """Files of one table, those of one header in one scan; a column that a file lacks is null in its rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: tuple(header(spark, p)), paths))
    groups: dict[tuple, list[str]] = {}
    for names, path in zip(headers, paths):
        groups.setdefault(names, []).append(path)
    frames = []
    for names, alike in groups.items():
        if names:
            schema = ", ".join(f"`{n}` {kind_of(n)}" for n in names)
            frames.append(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(alike, schema=schema))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def read_data(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    """A base table from files whose columns are told by name, in any order; an error for names that the table hasn't."""
    kinds = {c.split()[0].strip("`"): c.split()[1] for c in SCHEMAS[name].split(", ")}

    def kind(column: str) -> str:
        if column not in kinds:
            raise ValueError(f"column {column!r} is unknown in {name}")
        return kinds[column]

    df = _by_name(spark, path, kind)
    df = spark.createDataFrame([], SCHEMAS[name]) if df is None else df
    df = df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    return df.withColumn("can_charge", F.col("can_charge").cast("boolean")) if name == "assets_storage_seasonal" else df


def read_profile_data(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A wide table: timestep long, and a double for each series that a header names."""
    df = _by_name(spark, path, lambda n: "long" if n == "timestep" else "double")
    return spark.createDataFrame([], "timestep long") if df is None else df


def read_data_from_dir(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All CSV tables of a folder that Spark can list, by table name; those that are absent are empty."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = sorted(str(s.getPath()) for s in fs.listStatus(root) if str(s.getPath()).endswith(".csv"))
    found = {n: spark.createDataFrame([], s.replace("can_charge string", "can_charge boolean")) for n, s in SCHEMAS.items()}
    for p in paths:
        name = table_name(p)
        if name in SCHEMAS:
            found[name] = read_data(spark, name, p)
        elif name.endswith("_raw"):
            found[name] = read_profile_data(spark, p)
    return found


def read_run_data(spark: SparkSession, path: str) -> DataFrame:
    """The experiment grid; an error if a column is missing."""
    names = set(header(spark, path))
    if missing := {c.split()[0] for c in GRID.split(", ")} - names:
        raise ValueError(f"columns missing in {path}: {', '.join(sorted(missing))}")
    kinds = dict(c.split() for c in GRID.split(", "))
    rows = _by_name(spark, path, lambda n: kinds.get(n, "string"))
    return rows.select(*kinds)


@dataclass(frozen=True)
class ExperimentResult:
    name: str
    seed: int
    n_rep_periods: int
    period_length: int
    clustering_type: str
    distance: str
    weight_type: str
    projection_error: float
    termination_status: str
    objective_value: float | None
    evaluation_termination_status: str
    evaluated_objective_value: float | None
    total_spillage: float
    total_borrow: float
    time_to_preprocess: float
    time_to_cluster: float
    time_to_fit_weights: float
    time_to_formulate_model: float
    time_to_solve: float

    def as_frame(self, spark: SparkSession, time_to_read: float) -> DataFrame:
        kinds = {"str": "string", "int": "long", "float": "double", "float | None": "double"}
        schema = ", ".join(f"{k} {kinds[t]}" for k, t in self.__annotations__.items())
        return spark.createDataFrame([tuple(asdict(self).values())], schema).withColumn("time_to_read", F.lit(float(time_to_read)))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def append_csv(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds the few rows of a frame to one CSV file, which gets a header when it is made. Folders are made as needed; the file is replaced as a whole in one step, so there is always the old or the new one."""
    lines = io.StringIO(newline="")
    out = csv.writer(lines, lineterminator="\n")
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        before = "".join(r[0] + "\n" for r in spark.read.text(path).coalesce(1).collect())
    else:
        before = ""
        out.writerow(rows.columns)
    out.writerows(rows.collect())
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray((before + lines.getvalue()).encode()))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), overwrite)


def _escaped(value) -> str:
    """A value as part of a folder's name, as partition discovery reads it."""
    return "".join(c if c.isalnum() or c in "_-. " else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _run_path(folder: str, run: dict) -> str:
    return "/".join([folder.rstrip("/"), *(f"{k}={_escaped(v)}" for k, v in run.items())])


def has_run(spark: SparkSession, folder: str, **run) -> bool:
    fs, target = _file_system(spark, _run_path(folder, run))
    return fs.exists(target)


def append_run(rows: DataFrame, folder: str, **run) -> bool:
    """Adds the rows of one run to a partitioned table of CSV parts, once: folder/key=value/... for the keys that name the run.

    Tasks write to a folder beside it, which then takes its place in one step. A run that is there already is left as it
    is, so a repeated one adds nothing; one that is killed leaves nothing that readers see. Returns whether it was added.
    """
    spark = rows.sparkSession
    fs, target = _file_system(spark, _run_path(folder, run))
    if fs.exists(target):
        return False
    staged_path = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"  # readers skip names that begin so
    _, staged = _file_system(spark, staged_path)
    try:
        rows.drop(*run).write.option("header", True).csv(staged_path)
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(staged, target):
            return False
        # of two that came at once, the later one may lie within the first
        inner = spark._jvm.org.apache.hadoop.fs.Path(target, staged.getName())
        if fs.exists(inner):
            fs.delete(inner, True)
            return False
        return True
    finally:
        fs.delete(staged, True)


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all runs; schema names the rows' columns, and then those of the run."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(folder)


def save_result(result: ExperimentResult, spark: SparkSession, path: str, time_to_read: float) -> None:
    append_csv(spark, path, result.as_frame(spark, time_to_read))


#: Files of a result's variables, and the keys of each.
VARIABLE_FILES = {
    "state_of_charge_inter": ("inter_period_storage_values.csv", {"id": "id", "t": "period"}),
    "state_of_charge_intra": ("intra_period_storage_values.csv", {"id": "id", "r": "rep_period", "t": "timestep"}),
    "invested_units": ("invested_units.csv", {"id": "id"}),
}


def save_variable(solution, name: str, keys: dict[str, str], path: str, seed: int) -> None:
    """Adds one variable's values (seed, its keys, value) to a file; nothing without an optimal solution or without rows."""
    if solution.status != "OPTIMAL" or solution.variables is None:
        return
    rows = solution.variables.where(F.col("name") == name).select(F.lit(seed).cast("long").alias("seed"), *(F.col(k).alias(v) for k, v in keys.items()), "value")
    if not rows.isEmpty():
        append_csv(rows.sparkSession, path, rows.orderBy(*keys.values()))


#: The columns of the partitioned tables of variables.
VARIABLE_SCHEMAS = {
    "state_of_charge_inter": "id string, period long, value double, name string, seed long",
    "state_of_charge_intra": "id string, rep_period long, timestep long, value double, name string, seed long",
    "invested_units": "id string, value double, name string, seed long",
}


def append_variables(solution, folder: str, result_name: str, seed: int) -> list[str]:
    """Storage levels and investments of one run, each added once to the partitioned table folder/its name; which were added. Nothing without an optimal solution or without rows."""
    if solution.status != "OPTIMAL" or solution.variables is None:
        return []
    added = []
    for name, (_, keys) in VARIABLE_FILES.items():
        rows = solution.variables.where(F.col("name") == name).select(*(F.col(k).alias(v) for k, v in keys.items()), "value")
        if not rows.isEmpty() and append_run(rows, f"{folder}/{name}", name=result_name, seed=seed):
            added.append(name)
    return added


def save_variables(solution, folder: str, result_name: str, seed: int) -> None:
    """Storage levels between and within periods, and investments, each in a file of the result's folder."""
    for name, (file, keys) in VARIABLE_FILES.items():
        save_variable(solution, name, keys, f"{folder}/{result_name}/{file}", seed)
