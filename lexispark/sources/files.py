"""Documentation trees and the files beside them."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.paths import in_excluded_folder, is_documentation, priority
from lexispark.functions.text import html_element, visible_text
from lexispark.operators.selection import budget_fold
from lexispark.scratch import exists


def walk(spark: SparkSession, root: str, max_file_bytes: int = 2_097_152, max_files: int = 5000) -> DataFrame:
    """The documentation files below a folder as (path, bytes), path relative to it. Contents are not read.

    Links, and what lies in excluded or hidden folders, are never looked at; of the others the first max(20,000,
    10 max_files) by path are.
    """
    base = root.rstrip("/").removeprefix("file:")
    # Links are told from files only where the folder is on this machine; other stores have none.
    links = [
        os.path.join(d, n) for d, dirs, names in (os.walk(base) if os.path.isdir(base) else ()) for n in [*dirs, *names]
        if os.path.islink(os.path.join(d, n))
    ]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^.*?{re.escape(base.lstrip('/'))}/", "")
    rows = files.select(path.alias("path"), F.col("path").alias("location"), F.col("length").alias("bytes"))
    for link in links:
        own = os.path.relpath(link, base)
        rows = rows.where((F.col("path") != own) & ~F.startswith(F.col("path"), F.lit(f"{own}/")))
    rows = rows.where(~in_excluded_folder(F.col("path"))).orderBy("path").limit(max(20_000, 10 * max_files))
    return rows.where(is_documentation(F.col("path")) & (F.col("bytes") <= max_file_bytes))


def read_bounded(
    spark: SparkSession, root: str, max_files: int = 5000, max_file_bytes: int = 2_097_152,
    max_index_bytes: int = 209_715_200
) -> DataFrame:
    """(path, content) of the files worth reading first, within twice the file limit and a byte budget.

    The budget is folded over names and sizes; only chosen files are read.
    """
    found = walk(spark, root, max_file_bytes, max_files).withColumn("p", -priority(F.col("path"))).withColumn("g", F.lit(1))
    budget = max_index_bytes + min(max_index_bytes, 64 * max_file_bytes)
    chosen = budget_fold(
        found.select("g", "p", "path", "bytes"), ["g"], ["p", "path"], "bytes", 2 * max_files, budget
    ).where("taken").select("path")
    locations = [
        r["location"] for r in found.join(chosen, "path").select("location").collect()
    ]  # at most 2 * max_files names
    if not locations:
        return spark.createDataFrame([], "path string, content string")
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    texts = spark.read.format("binaryFile").load(locations)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^.*?{base}/", "")
    return texts.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))


CONFIG = "projectTitle string, description string, branch string, folders array<string>, excludeFolders array<string>, excludeFiles array<string>, rules array<string>, previousVersions array<struct<tag string>>, branchVersions array<struct<branch string>>"


def project_config(text: Column, most_bytes: int = 1 << 20) -> Column:
    """A project's settings; comments are allowed, what is no object or too large has only nulls."""
    parsed = F.from_json(text, CONFIG, {"mode": "PERMISSIVE", "allowComments": "true"})
    return F.when(F.octet_length(text) <= most_bytes, parsed)


def versions(config: Column) -> Column:
    """Tags, then branches, as they are listed."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(F.transform(config["previousVersions"], lambda v: v["tag"]), none),
        F.coalesce(F.transform(config["branchVersions"], lambda v: v["branch"]), none)
    )


def json_string(text: Column, path: str) -> Column:
    """A trimmed string field; null if it is empty or of another type."""
    value = F.variant_get(F.try_parse_json(text), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.trim(F.get_json_object(text, path)), F.lit("")))


def json_number(text: Column, path: str) -> Column:
    """A finite number field; null for another type."""
    value = F.variant_get(F.try_parse_json(text), path, "variant")
    return F.when(
        F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"),
        F.get_json_object(text, path).try_cast("double")
    )


def dependencies(manifests: DataFrame) -> DataFrame:
    """Distinct names that package.json, requirements.txt and pyproject.toml files (path, content) depend on."""
    c = F.col("content")
    kinds = "map<string,string>"
    keys = lambda p: F.coalesce(
        F.map_keys(F.from_json(F.get_json_object(c, p), kinds)), F.array().cast("array<string>")
    )
    npm = F.filter(F.concat(keys("$.dependencies"), keys("$.devDependencies")), lambda n: ~n.startswith("@types/"))
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x))
    name = lambda x: F.regexp_extract(x, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    pip = F.transform(F.filter(lines, lambda x: x.rlike("^[A-Za-z0-9]")), name)
    listed = F.regexp_extract(c, r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\]\s*(?:\n|$)", 1)
    project = F.transform(F.regexp_extract_all(listed, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), name)
    table = F.regexp_extract(c, r"(?s)\[tool\.poetry\.dependencies\](.*?)(?:\n\[|$)", 1)
    poetry = F.filter(
        F.regexp_extract_all(table, F.lit(r"(?m)^([A-Za-z0-9._-]+)\s*="), F.lit(1)), lambda n: n != "python"
    )
    of = F.when(F.col("path").endswith("package.json"), npm).when(F.col("path").endswith("requirements.txt"), pip).when(
        F.col("path").endswith("pyproject.toml"), F.concat(project, poetry)
    )
    return manifests.select(F.explode(of).alias("name")).where("name != ''").distinct()


def skill_files(tree: DataFrame, prefix: str = "") -> DataFrame:
    """Skill files of a repository tree (path, type) below a prefix."""
    return tree.where(
        (F.col("type") == "blob") & F.lower("path").endswith("skill.md") & F.startswith(F.col("path"), F.lit(prefix))
    )


def preferred_commit(refs: DataFrame, ref: str) -> DataFrame:
    """The commit of a ref in lines of ``sha<tab>name``: what a tag points to, if it is listed."""
    parts = F.split("value", r"\s+")
    rows = refs.select(parts[0].alias("sha"), parts[1].alias("name"))
    own = rows.where(F.regexp_replace("name", r"\^\{\}$", "").isin(ref, f"refs/heads/{ref}", f"refs/tags/{ref}"))
    return own.orderBy(F.col("name").endswith("^{}").desc(), "name").limit(1).select("sha")


def toml_section(text: Column, section: str) -> Column:
    """The keys of a TOML section with their values as JSON texts."""
    body = F.regexp_extract(text, rf"(?s)(?:^|\n)\[{section}\][^\n]*\n(.*?)(?:\n\[|$)", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z0-9_-]+\s*="))
    return F.map_from_entries(
        F.transform(
            lines,
            lambda x: F.struct(
                F.regexp_extract(x, r"^\s*([A-Za-z0-9_-]+)", 1).alias("k"),
                F.trim(F.regexp_extract(x, "=(.*)$", 1)).alias("v")
            )
        )
    )


def installed_skills(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Skills (location, name) in folders of skills: a folder with a skill file, by the file listing alone.

    A location that isn't there has no skills.
    """
    rows = spark.createDataFrame([], "location string, name string")
    for root in roots:
        if not exists(spark, root):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "SKILL.md"
        ).load(root).select("path")
        rows = rows.unionByName(
            found.select(
                F.lit(root).alias("location"), F.regexp_extract("path", "([^/]+)/SKILL\\.md$", 1).alias("name")
            )
        )
    return rows.where("name != ''").distinct()


def list_links(text: Column) -> Column:
    """The links of an llms.txt file: structs of section, title, url and description."""
    marked = F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+")
    line = r"\n[-*][ \t]+\[([^\]\n]*)\]\(([^)\s]+)\)(?::[ \t]*([^\n]*))?"

    def links(part: Column, k: Column) -> Column:
        section = F.when(k > 0, F.trim(F.split_part(part, F.lit("\n"), F.lit(1))))
        found = F.regexp_extract_all(F.concat(F.lit("\n"), part), F.lit(line), F.lit(0))
        return F.transform(
            found,
            lambda x: F.struct(
                section.alias("section"), F.regexp_extract(x, line, 1).alias("title"),
                F.regexp_extract(x, line, 2).alias("url"),
                F.nullif(F.trim(F.regexp_extract(x, line, 3)), F.lit("")).alias("description")
            )
        )

    return F.flatten(F.transform(marked, links))


def api_operations(text: Column) -> Column:
    """The operations of an OpenAPI document in JSON: structs of path, method, summary and description, by path and
    method."""
    kind = "map<string,map<string,struct<summary string, description string>>>"
    paths = F.map_entries(F.coalesce(F.from_json(F.get_json_object(text, "$.paths"), kind), F.create_map().cast(kind)))
    methods = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
    made = F.transform(
        paths,
        lambda p: F.transform(
            F.filter(F.map_entries(p["value"]), lambda m: F.lower(m["key"]).isin(methods)),
            lambda m: F.struct(
                p["key"].alias("path"), F.lower(m["key"]).alias("method"), m["value"]["summary"].alias("summary"),
                m["value"]["description"].alias("description")
            )
        )
    )
    return F.sort_array(F.flatten(made))


def wiki_page(storage: Column) -> Column:
    """A wiki page in storage format as a struct of title (its first heading) and visible text; code macros keep their
    text."""
    plain = F.regexp_replace(storage, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.struct(html_element(plain, "h1").alias("title"), visible_text(plain).alias("text"))


def site_pages(pages: DataFrame, exclude: list[str], max_pages: int = 100, max_depth: int = 3) -> DataFrame:
    """Pages (url, depth) of a site within limits: no excluded path, not too deep, the shallowest first; urls without fragment."""
    from lexispark.functions.identifiers import canonical_url
    from lexispark.functions.paths import in_folder

    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    keep = F.col("depth") <= max_depth
    for pattern in exclude:
        keep &= ~in_folder(F.ltrim(path, F.lit("/")), pattern)
    rows = pages.where(keep).withColumn("url", canonical_url(F.col("url")))
    return rows.groupBy("url").agg(F.min("depth").alias("depth")).orderBy("depth", "url").limit(max_pages)
