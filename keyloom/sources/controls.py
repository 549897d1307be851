"""Invented secrets of known families, and files that hold them: what recall is measured with.

Each character is a hash of seed, family, number and place, so a control is the
same whatever the partitioning, and any number of them is made in parallel.
Prefixes are aliases of the real ones, so that no control is a usable secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
BASE62 = DIGITS + LOWER.upper() + LOWER
HEX = DIGITS + "abcdef"

# The families of controls, each with its parts: text as it stands, or an alphabet and a length.
FAMILIES: dict[str, tuple] = {
    "stripe": ("stk_live_", (BASE62, 24)),
    "github_pat": ("ght_", (BASE62, 36)),
    "aws_pair": ("AXIA", (LOWER.upper() + DIGITS, 16), "|", (BASE62 + "/+", 40)),
    "google_api": ("GIZA", (BASE62 + "-_", 35)),
    "slack_bot": ("xotb-", (DIGITS, 12), "-", (DIGITS, 12), "-", (BASE62, 24)),
    "jwt": ("eyJ", (BASE62, 33), ".eyJ", (BASE62, 60), ".", (BASE62, 43)),
    "pem_private": ("-----BEGIN PRIVATE KEY-----", (BASE62 + "/+", 64), "-----END PRIVATE KEY-----"),
    "generic_bearer": ("Bearer ", (BASE62, 40)),
    "opaque_api_secret": ((BASE62, 32),),
    "opaque_session_token": ((HEX, 48),),
    "opaque_random_cred": ((BASE62 + "-_", 28),),
}
FORMATS = ("python", "env", "yaml", "json", "toml", "markdown")
NAMES = {"stripe": "stripe_api_key", "github_pat": "github_token", "aws_pair": "aws_secret", "google_api": "google_api_key", "slack_bot": "slack_token", "jwt": "auth_token", "pem_private": "private_key", "generic_bearer": "bearer_token", "opaque_api_secret": "api_secret", "opaque_session_token": "session_token", "opaque_random_cred": "db_password"}
ENDINGS = {"python": ".py", "env": ".env", "yaml": ".yaml", "json": ".json", "toml": ".toml", "markdown": ".md"}
FOLDERS = ("src", "lib", "config", "app/core", "scripts")


def _drawn(seed: int, part: int, alphabet: str, length: int) -> Column:
    draw = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(seed), F.col("family"), F.col("n"), F.lit(part), i), F.lit(len(alphabet))) + 1).cast("int"), 1)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), draw), "")


def generate(spark: SparkSession, per_family: int, seed: int = 42) -> DataFrame:
    """``control_id, family, value``: as many controls of each family."""
    rows = spark.range(per_family * len(FAMILIES)).select(F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("id") % len(FAMILIES) + 1).cast("int")).alias("family"), F.floor(F.col("id") / len(FAMILIES)).alias("n"))
    value = F.when(F.lit(False), "")
    for family, parts in FAMILIES.items():
        value = value.when(F.col("family") == family, F.concat(*[F.lit(p) if isinstance(p, str) else _drawn(seed, k, *p) for k, p in enumerate(parts)]))
    return rows.select(F.format_string("%s-%05d", "family", "n").alias("control_id"), "family", value.alias("value"))


def _line(file_format: Column, name: Column, value: Column) -> Column:
    return (
        F.when(file_format == "python", F.format_string('%s = "%s"', name, value)).when(file_format == "env", F.format_string("%s=%s", F.upper(name), value)).when(file_format == "yaml", F.format_string('%s: "%s"', name, value))
        .when(file_format == "json", F.format_string('{"%s": "%s"}', name, value)).when(file_format == "toml", F.format_string('%s = "%s"', name, value)).otherwise(F.format_string("Set `%s` to `%s`.", name, value))
    )


def seed_files(controls: DataFrame, seed: int = 42) -> DataFrame:
    """``control_id, family, file_format, repo, file_path, expected_value, content``: a file for each control, of a format and folder that hashes choose.

    Of a pair of values the second is written.
    """
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("control_id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    rows = controls.withColumn("file_format", pick(FORMATS, "format"))
    path = F.concat(pick(FOLDERS, "folder"), F.lit("/"), F.col("control_id"), table(ENDINGS)[F.col("file_format")])
    written = F.when(F.col("family") == "aws_pair", F.get(F.split("value", r"\|"), 1)).otherwise(F.col("value"))
    content = F.concat(_line(F.col("file_format"), table(NAMES)[F.col("family")], written), F.lit("\n"))
    return rows.select("control_id", "family", "file_format", F.lit("seeded").alias("repo"), path.alias("file_path"), F.col("value").alias("expected_value"), content.alias("content"))
