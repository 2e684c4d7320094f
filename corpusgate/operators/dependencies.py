"""Dependency checks: pins in manifests, lockfiles beside manifests, declared against imported packages.

`files` has repo, rev, path and text. Every join is keyed by repo and rev, so a package that all repositories use
makes no hot key. JSON goes through VARIANT; TOML is parsed by a helper that yields rows.
"""

from __future__ import annotations

import sys
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.ship import ship
from corpusgate.functions.text import JS, PYTHON, SOURCE, file_name, is_test_path, splitlines, suffix
from corpusgate.operators.astscan import python_imports
from corpusgate.operators.findings import finding, union
from corpusgate.operators.textscan import TREE, unpinned_actions

#: Names, sections and patterns of manifests.
EXACT_VERSION = "^[0-9]+\\.[0-9]+\\.[0-9]+([-+][0-9A-Za-z.-]+)?$"
PINNED_COMMIT = "#[0-9a-f]{40}$"
LOCAL = "^(file|workspace|link|portal):"
NAME = "^\\s*([A-Za-z0-9][A-Za-z0-9._-]*)"
HASH_OPTION = "\\s--hash=\\S+"
EXACT_REQUIREMENT = "^[A-Za-z0-9._-]+(\\[[^\\]]*\\])?\\s*==\\s*[^=*,;\\s]+\\s*(;.*)?$"
JS_IMPORT = "(?:\\bfrom\\s+|\\bimport\\s+|\\brequire\\(\\s*)['\"]([^'\"]+)['\"]"
JSON_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]
LOCKFILES = [
    ("package.json", "package-lock.json"), ("package.json", "yarn.lock"), ("package.json", "pnpm-lock.yaml"),
    ("package.json", "npm-shrinkwrap.json"), ("package.json", "bun.lockb"), ("pyproject.toml", "poetry.lock"),
    ("pyproject.toml", "uv.lock"), ("pyproject.toml", "pdm.lock"), ("Cargo.toml", "Cargo.lock"), ("go.mod", "go.sum"),
    ("Pipfile", "Pipfile.lock"),
]
IMPORT_NAMES = {
    "pyyaml": "yaml", "beautifulsoup4": "bs4", "pillow": "PIL", "scikit-learn": "sklearn", "python-dateutil": "dateutil",
    "opencv-python": "cv2", "protobuf": "google", "attrs": "attr",
}
NODE_MODULES = (
    "assert buffer child_process crypto events fs http https net os path process querystring readline stream timers tls url util "
    "worker_threads zlib"
).split()


def _unpinned(name: Column, spec: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("' uses unpinned spec '"), spec, F.lit("'"))


def _json_entries(files: DataFrame, sections: list[str]) -> DataFrame:
    """TREE, path, section, name, spec of each entry of package.json files; what isn't an object is passed over."""
    parsed = files.filter(file_name(F.col("path")) == "package.json").withColumn("data", F.try_parse_json("text"))
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.try_variant_get("data", f"$.{s}", "variant").alias("entries")) for s in sections]))
    rows = parsed.select(*TREE, "path", parts.alias("part")).select(*TREE, "path", "part.*")
    rows = rows.filter(F.schema_of_variant("entries").startswith("OBJECT"))
    found = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("entries").outer()))
    text = F.try_variant_get("value", "$", "string")
    return found.select(*TREE, "path", "section", F.col("key").alias("name"), F.coalesce(text, F.to_json("value")).alias("spec"))


def unpinned_package_json(files: DataFrame) -> DataFrame:
    entries = _json_entries(files, JSON_SECTIONS)
    pinned = F.col("spec").rlike(EXACT_VERSION) | F.col("spec").rlike(PINNED_COMMIT) | F.col("spec").rlike(LOCAL)
    return entries.filter(~pinned).select(*TREE, "path", *finding("D1", _unpinned(F.col("name"), F.col("spec")), False, F.lit(1)))


def logical_requirements(text: Column) -> Column:
    """array<struct<line, requirement>>: lines joined over trailing backslashes, each at the number of its first."""
    lines = F.transform(splitlines(text), lambda x, i: F.struct((i + 1).alias("line"), F.rtrim(F.regexp_replace(x, "\\s+$", "")).alias("text")))
    start = F.struct(F.array().cast("array<struct<line:int,requirement:string>>").alias("done"), F.lit(False).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = x["text"].endswith("\\")
        part = F.regexp_replace(x["text"], "\\\\$", "")
        last = F.try_element_at(acc["done"], F.lit(-1))
        joined = F.struct(last["line"].alias("line"), F.concat_ws(" ", last["requirement"], part).alias("requirement"))
        fresh = F.struct(x["line"].cast("int").alias("line"), part.alias("requirement"))
        size = F.size(acc["done"])
        done = F.when(acc["open"] & (size > 0), F.concat(F.slice(acc["done"], F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(joined)))
        return F.struct(done.otherwise(F.concat(acc["done"], F.array(fresh))).alias("done"), goes_on.alias("open"))

    joined = F.aggregate(lines, start, step)["done"]
    clean = lambda t: F.trim(F.regexp_replace(F.concat(F.lit(" "), t), HASH_OPTION, ""))
    return F.transform(joined, lambda r: F.struct(r["line"].alias("line"), clean(r["requirement"]).alias("requirement")))


def unpinned_lines(rows: DataFrame) -> DataFrame:
    """Findings for rows with TREE, path, line, requirement."""
    wanted = F.trim(F.element_at(F.split("requirement", " #", 2), 1))
    rows = rows.withColumn("wanted", wanted).filter((F.col("wanted") != "") & ~F.col("wanted").rlike("^[#-]"))
    pinned = F.col("wanted").rlike(EXACT_REQUIREMENT) | (F.col("wanted").contains("@") & F.col("wanted").contains("#sha256="))
    message = F.concat(F.lit("unpinned requirement '"), "wanted", F.lit("'"))
    return rows.filter(~pinned).select(*TREE, "path", *finding("D1", message, False))


def unpinned_requirements(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    listed = files.filter(name.startswith("requirements") & name.endswith(".txt"))
    rows = listed.select(*TREE, "path", F.explode(logical_requirements(F.col("text"))).alias("r")).select(*TREE, "path", "r.*")
    return unpinned_lines(rows)


def toml_entries(files: DataFrame) -> DataFrame:
    """TREE, path, section, name, version, is_local: a row for each dependency that a TOML manifest declares.

    section is project (version holds the requirement), poetry, or a section of Cargo. A file that can't be parsed has none."""
    ship(files.sparkSession)
    rows = files.filter(file_name(F.col("path")).isin("pyproject.toml", "Cargo.toml")).select(*TREE, "path", "text")
    schema = "repo string, rev string, path string, section string, name string, version string, is_local boolean"
    return rows.mapInArrow(_toml_rows, schema)


def _table(data: object, *keys: str) -> dict:
    for key in keys:
        data = data.get(key) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else {}


def _declared(path: str, text: str) -> Iterator[tuple[str, str | None, str, bool]]:
    try:
        data = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError, MemoryError):
        return
    if path.rsplit("/", 1)[-1] == "Cargo.toml":
        tables = [(s, _table(data, s)) for s in CARGO_SECTIONS]
    else:
        project = _table(data, "project")
        extras = project.get("optional-dependencies") or {}
        for section, group in [("project", project.get("dependencies") or []), *(("extra", x) for x in extras.values())]:
            yield from ((section, None, str(x), False) for x in group)
        tables = [("poetry", _table(data, "tool", "poetry", "dependencies"))]
    for section, entries in tables:
        for name, spec in entries.items():
            inner = spec if isinstance(spec, dict) else {"version": str(spec)}
            yield section, name, str(inner.get("version", "")), "path" in inner or "rev" in inner


def _toml_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            {"repo": r["repo"], "rev": r["rev"], "path": r["path"], "section": s, "name": n, "version": v, "is_local": local}
            for r in batch.to_pylist()
            for s, n, v, local in _declared(r["path"] or "", r["text"] or "")
        ]
        fields = [(k, pa.string()) for k in ("repo", "rev", "path", "section", "name", "version")] + [("is_local", pa.bool_())]
        yield pa.RecordBatch.from_pylist(out, pa.schema(fields))


def unpinned_pyproject(files: DataFrame) -> DataFrame:
    entries = toml_entries(files.filter(file_name(F.col("path")) == "pyproject.toml"))
    listed = entries.filter(F.col("section").isin("project", "extra")).select(*TREE, "path", F.lit(1).alias("line"), F.col("version").alias("requirement"))
    poetry = entries.filter("section = 'poetry' and name <> 'python' and not is_local")
    loose = poetry.filter(~F.regexp_replace("version", "^=+", "").rlike(EXACT_VERSION))
    loose = loose.select(*TREE, "path", *finding("D1", _unpinned(F.col("name"), F.col("version")), False, F.lit(1)))
    return unpinned_lines(listed).unionByName(loose)


def unpinned_cargo(files: DataFrame) -> DataFrame:
    """A bare version is a range, so only those with = are pins."""
    entries = toml_entries(files.filter(file_name(F.col("path")) == "Cargo.toml")).filter("not is_local")
    loose = entries.filter(~F.col("version").startswith("="))
    return loose.select(*TREE, "path", *finding("D1", _unpinned(F.col("name"), F.col("version")), False, F.lit(1)))


def unpinned(files: DataFrame) -> DataFrame:
    """All manifests and workflows, each by the rule for its name."""
    parts = (unpinned_package_json, unpinned_requirements, unpinned_pyproject, unpinned_cargo, unpinned_actions)
    return union([part(files) for part in parts])


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def lockfile_drift(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Manifests without a lockfile in their folder and, with changes (TREE, path), those of which one changed alone."""
    spark = files.sparkSession
    # Eleven rows, so they are broadcast; what is joined to the files is no more than the manifests.
    locks = F.broadcast(spark.createDataFrame(LOCKFILES, "manifest string, lock string"))
    manifests = files.select(*TREE, "path", file_name(F.col("path")).alias("manifest"))
    wanted = manifests.join(locks, "manifest").select(*TREE, "path", F.concat(folder(F.col("path")), "lock").alias("lock_path"))
    names = [x for pair in LOCKFILES for x in pair[1:]]
    present = files.filter(file_name(F.col("path")).isin(names)).select(*TREE, F.col("path").alias("lock_path"), F.lit(True).alias("present"))
    rows = wanted.join(present, [*TREE, "lock_path"], "left")
    if changes is not None:
        own = changes.select(*TREE, "path", F.lit(True).alias("changed")).distinct()
        rows = rows.join(own, [*TREE, "path"], "left").join(
            own.select(*TREE, F.col("path").alias("lock_path"), F.col("changed").alias("lock_changed")), [*TREE, "lock_path"], "left"
        )
    else:
        rows = rows.withColumn("changed", F.lit(None).cast("boolean")).withColumn("lock_changed", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    by = rows.groupBy(*TREE, "path").agg(
        yes("present").alias("present"),
        yes("changed").alias("changed"),
        F.coalesce(F.bool_or(F.col("present") & F.col("lock_changed")), F.lit(False)).alias("lock_changed"),
    )
    message = (
        F.when(~F.col("present"), "manifest has no lockfile")
        .when(F.col("changed") & ~F.col("lock_changed"), "manifest changed without its lockfile")
        .when(~F.col("changed") & F.col("lock_changed"), "lockfile changed alone")
    )
    return by.select(*TREE, "path", *finding("D2", message, False, F.lit(1))).filter("message is not null")


def untested_changes(changes: DataFrame, key: list[str]) -> DataFrame:
    """Change sets (key, ord, path) with source files but no test: a finding at the first of these files."""
    test = is_test_path(F.col("path"))
    rows = changes.select(*key, "ord", "path", test.alias("test"), (suffix(F.col("path")).isin(SOURCE) & ~test).alias("source"))
    by = rows.groupBy(*key).agg(
        F.bool_or("test").alias("tested"),
        F.count_if("source").alias("sources"),
        F.min(F.when(F.col("source"), F.struct("ord", "path")))["path"].alias("path"),
    )
    message = F.concat(F.col("sources").cast("string"), F.lit(" source file(s) changed without a test change"))
    return by.filter("not tested and sources > 0").select(*key, "path", *finding("C3", message, False, F.lit(1)))


def import_name(package: Column) -> Column:
    """The usual import name of a distribution."""
    plain = F.lower(F.regexp_replace(package, "[-_.]+", "-"))
    known = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), F.replace(plain, F.lit("-"), F.lit("_")))


def _compared(declared: DataFrame, imported: DataFrame, ignored: DataFrame | None) -> DataFrame:
    """declared: TREE, name, path; imported: TREE, name, path of the first file; ignored: names that need no declaration."""
    keys = [*TREE, "name"]
    unused = declared.join(imported, keys, "left_anti")
    unused = unused.select(*TREE, "path", *finding("D5", F.concat(F.lit("'"), "name", F.lit("' is declared but never imported")), False, F.lit(1)))
    missing = imported.join(declared, keys, "left_anti")
    if ignored is not None:
        missing = missing.join(ignored, keys, "left_anti")
    missing = missing.select(*TREE, "path", *finding("D5", F.concat(F.lit("'"), "name", F.lit("' is imported but not declared")), False, F.lit(1)))
    return unused.unionByName(missing)


def standard_modules(spark: SparkSession) -> DataFrame:
    """Names of the standard library's modules in the Python that runs this: a few hundred rows."""
    return spark.createDataFrame([(x,) for x in sorted(sys.stdlib_module_names)], "name string")


def unused_python(files: DataFrame) -> DataFrame:
    """Trees with a manifest at their root: packages that are declared but never imported, and the other way round."""
    spark = files.sparkSession
    at_root = files.filter(F.col("path").isin("requirements.txt", "pyproject.toml"))
    trees = at_root.select(*TREE).distinct()
    lines = at_root.filter("path = 'requirements.txt'").select(*TREE, "path", F.explode(splitlines(F.col("text"))).alias("requirement"))
    lines = lines.filter(~F.ltrim("requirement").rlike("^[#-]"))
    project = toml_entries(at_root.filter("path = 'pyproject.toml'")).filter("section = 'project'")
    both = lines.unionByName(project.select(*TREE, "path", F.col("version").alias("requirement")))
    both = both.withColumn("package", F.regexp_extract("requirement", NAME, 1)).filter("package <> ''")
    # pyproject.toml, the smaller name, stands for what both declare.
    declared = both.groupBy(*TREE, import_name(F.col("package")).alias("name")).agg(F.min("path").alias("path"))
    sources = files.filter(suffix(F.col("path")).isin(PYTHON)).join(trees, TREE, "left_semi")
    imported = python_imports(sources).groupBy(*TREE, "name").agg(F.min("path").alias("path"))
    stem = F.regexp_replace(file_name(F.col("path")), "\\.py$", "")
    parent = F.element_at(F.split("path", "/"), -2)
    local = sources.select(*TREE, F.explode(F.array(stem, F.when((stem == "__init__") & F.col("path").contains("/"), parent))).alias("name"))
    local = local.filter("name is not null").distinct()
    # Standard modules need no declaration, but a declared package of such a name counts as used if it is imported.
    trees_local = local.unionByName(imported.join(F.broadcast(standard_modules(spark)), "name", "left_semi").select(*TREE, "name"))
    return _compared(declared, imported, trees_local)


def js_package(specifier: Column) -> Column:
    """The package of an import, null for relative paths and Node's own modules."""
    parts = F.split(specifier, "/")
    name = F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))
    return F.when(~specifier.rlike("^(\\.|/|node:)") & ~name.isin(NODE_MODULES), name)


def unused_js(files: DataFrame) -> DataFrame:
    """Trees with a package.json at their root, likewise."""
    manifest = files.filter("path = 'package.json'")
    declared = _json_entries(manifest, JSON_SECTIONS).select(*TREE, "name", "path").distinct()
    sources = files.filter(suffix(F.col("path")).isin(JS)).join(manifest.select(*TREE).distinct(), TREE, "left_semi")
    found = sources.select(*TREE, "path", F.explode(F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(1))).alias("specifier"))
    imported = found.withColumn("name", js_package(F.col("specifier"))).filter("name is not null")
    imported = imported.groupBy(*TREE, "name").agg(F.min("path").alias("path"))
    rows = _compared(declared, imported, None)
    return rows.filter(~F.col("message").rlike("^'@types/.* is declared but never imported$"))
