"""Job directories: node metadata, force-field metadata, system XML, task contracts and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "node_type string, status string, metadata struct<temperature_kelvin:double,pressure_bar:double,simulation_time_ns:double,"
    "timestep_fs:double,hmr:string,system_signature:struct<ensemble:string>>"
)
AMBER = "parameters struct<water_model:string>, forcefield_provenance struct<openmm_xml:array<string>>"
CHECK = (
    "struct<check_id:string,check_type:string,capability:string,category:string,weight:double,expected_residue_count:int,expected_chain_count:int,"
    "expected_heavy_atoms:int,expected_total_protein_atoms:int,total_atom_tolerance:int,expected_water_model:string,expected_temperature_k:double,"
    "temperature_tolerance_k:double,expected_ensemble:string,minimum_production_ns:double,require_finite_coordinates:boolean,"
    "minimum_measured_fraction_of_claim:double,contract_id:string,test_id:string,observable:string,minimum:double,maximum:double,note:string,"
    "expected_complete_residues:map<string,string>,expected_heavy_atoms_per_residue:int,expected_pairs:array<array<int>>,maximum_sg_distance_angstrom:double>"
)
TASK = (
    "schema_version string, task_id string, capability_tags array<string>, reference struct<database:string,api:string,accession:string,retrieved:string,"
    "license:string,license_url:string,citation:string,pdb_ids:array<string>,"
    "reference_conditions:struct<FF:array<string>,WAT:string,TEMP:double,ENSEMBLE:string,TIMESTEP:double,LENGTH:double,PROGRAM:string,METHOD:string>,"
    "reference_system:struct<PROTRES:int,PROTATS:int,heavy_atoms:int,SOL:int,NA:int,CL:int>,"
    "bundle:struct<fetch:string,sha256:map<string,string>,policy:string>>, "
    f"scoring struct<deterministic_checks:array<{CHECK}>>"
)


def read_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON documents with their path."""
    return spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))


def read_nodes(spark: SparkSession, job_dirs: str | list[str]) -> DataFrame:
    """node.json of every node directory below the job directories, with job and node folders."""
    dirs = [job_dirs] if isinstance(job_dirs, str) else job_dirs
    nodes = read_documents(spark, [f"{d}/nodes/*/node.json" for d in dirs], NODE)
    return nodes.withColumns({"node": F.regexp_replace("path", "/node\\.json$", ""), "job": F.regexp_replace("path", "/nodes/[^/]*/node\\.json$", "")})


def latest_completed(nodes: DataFrame) -> DataFrame:
    """The completed node of each job and type that is last in path order (prod_10 comes before prod_2)."""
    last = F.max_by(F.struct("node", "metadata"), "path")
    return nodes.where("status = 'completed'").groupBy("job", "node_type").agg(last.alias("n")).select("job", "node_type", "n.*")


def read_system_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, particles, nonbonded (number of parameterised particles) and charge of serialised systems.

    Charges are those of the first NonbondedForce. A document that does not parse raises.
    """
    force = '/System/Forces/Force[@type="NonbondedForce"][1]/Particles/Particle/@q'
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    got = text.select("path", F.xpath("value", F.lit("/System/Particles/Particle/@mass")).alias("m"), F.xpath("value", F.lit(force)).alias("q"))
    total = F.aggregate(F.transform("q", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return got.select("path", F.size("m").alias("particles"), F.size("q").alias("nonbonded"), total.alias("charge"))


def read_tasks(spark: SparkSession, dataset_dir: str) -> DataFrame:
    return read_documents(spark, f"{dataset_dir}/tasks/*/task.json", TASK)


def checks_of(tasks: DataFrame) -> DataFrame:
    """One row for each task and check, the check's fields as columns."""
    return tasks.select("task_id", F.explode("scoring.deterministic_checks").alias("c")).select("task_id", "c.*")
