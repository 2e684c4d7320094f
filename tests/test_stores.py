"""What is kept between runs: findings by unit, results by blob; trees read without the folders that are skipped; histories."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusgate.operators import commits, content, findings

FINDING = "repo string, path string, line int, class_id string, message string, blocking boolean"


def test_a_rerun_replaces_its_own_units(spark, tmp_path):
    rows = [("a/b", "p", 1, "M12", "m", True), ("a/b", "p", 2, "Q3", "m", False), ("other", "p", 3, "Q3", "m", False), (None, "p", 4, "Q3", "m", False), ("gone", "p", 5, "Q3", "m", False)]
    first = spark.createDataFrame(rows, FINDING)
    again = spark.createDataFrame([("a/b", "q", 9, "Q3", "m", False)], FINDING)
    scanned = spark.createDataFrame([("a/b",), ("gone",), ("never",)], "repo string")
    for form in ("json", "parquet", "text"):
        path = f"{tmp_path}/{form}"
        findings.write_findings(first, path, form, ["repo"])
        findings.write_findings(again, path, form, ["repo"], scanned)
        line = F.regexp_extract("value", ":([0-9]+):", 1).cast("int") if form == "text" else F.col("line")
        kinds = "repo string, class string, " + ("value string" if form == "text" else "line int")
        kept = spark.read.schema(kinds).format(form).load(path).select("repo", "class", line.alias("line")).collect()
        assert {tuple(r) for r in kept} == {("a/b", "Q3", 9), ("other", "Q3", 3), (None, "Q3", 4)}
        findings.write_findings(first.limit(0), path, form, ["repo"], scanned)
        assert {r.repo for r in spark.read.schema(kinds).format(form).load(path).collect()} == {"other", None}


def test_findings_are_scanned_once_for_all_forms(spark, monkeypatch):
    """What is written in three forms, twice, is read from a table; the scans aren't in the plan any more."""
    from conftest import DATA
    from corpusgate.jobs.queries import stores

    plans, write = [], findings.write_findings
    monkeypatch.setattr(findings, "write_findings", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, *rest)))
    stores.findings_written_twice(spark, str(DATA))
    assert len(plans) == 6 and not any("Generate" in plan for plan in plans)


def test_a_second_run_scans_unseen_blobs_only(spark, tmp_path):
    files = [("r", "h", "a", "1", "x"), ("r", "h", "b", "1", "x"), ("r", "h", "c", "2", "yy"), ("r", "h", "d", None, "z"), ("r", "h", "e.md", "2", "yy")]
    files = spark.createDataFrame(files, "repo string, rev string, path string, blob_id string, text string")
    store = content.BlobStore(spark, f"{tmp_path}/store", "STRUCT<size: INT, again: INT>", 4)
    seen = spark.sparkContext.accumulator(0)
    dispatch = F.when(F.col("path").endswith(".md"), "prose").otherwise("code")

    def scan(blobs):
        n = blobs.count()
        seen.add(n)
        size = F.length("text")
        return blobs.select("blob_id", "dispatch", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("again")).filter("size > 1")

    whole = {("c", "code", 2, 1), ("c", "code", 2, 2), ("e.md", "prose", 2, 1), ("e.md", "prose", 2, 2)}
    first = content.scan_new_blobs(files.filter("path in ('a', 'c')"), dispatch, scan, store)
    assert {(r.path, r.dispatch, r.size, r.again) for r in first.collect()} == {x for x in whole if x[0] == "c"}
    assert seen.value == 2
    second = content.scan_new_blobs(files, dispatch, scan, content.BlobStore(spark, f"{tmp_path}/store", "STRUCT<size: INT, again: INT>", 4))
    assert {(r.path, r.dispatch, r.size, r.again) for r in second.collect()} == whole
    assert seen.value == 3  # the same text as prose is scanned; blob 1, which has no finding, isn't again
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = files.withColumn("dispatch", dispatch).join(store.rows(), ["blob_id", "dispatch"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_trees_are_read_without_skipped_folders(spark, tmp_path):
    for path in ("top.txt", "a/x.py", "a/b [c]/y{1}.py", "a/node_modules/z.js", "vendor/deep/q.py", "build/o.txt", "a/b [c]/.venv/v.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    read = content.read_tree(spark, str(tmp_path), "r")
    assert {(r.path, bytes(r.content).decode()) for r in read.collect()} == {(p, p) for p in ("top.txt", "a/x.py", "a/b [c]/y{1}.py")}
    (tmp_path / "a/k=1").mkdir()
    (tmp_path / "a/k=1/w.py").write_text("w")
    assert {r.path for r in content.read_tree(spark, str(tmp_path)).collect()} == {"top.txt", "a/x.py", "a/b [c]/y{1}.py", "a/k=1/w.py"}
    only = tmp_path / "vendor"
    assert {r.path for r in content.read_tree(spark, str(only)).collect()} == {"deep/q.py"}


def test_a_tree_is_written_without_checksums_and_listed_in_few_tasks(spark, tmp_path):
    """Each document costs one file and no more; names are listed by tasks of many files."""
    from corpusgate.jobs.queries import stores
    from corpusgate.functions.shared import shared_folder
    from pathlib import Path

    rows = [(i, None if i in (5, 40) else f"text {i}\n\u00e9") for i in [*range(400), 3, None]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before, tracker = set(Path(shared_folder(spark)).glob("tree-*")), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree", "tree")
    read = stores.tree_read(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    made = [p for p in (set(Path(shared_folder(spark)).glob("tree-*")) - before).pop().rglob("*") if p.is_file()]
    assert len(made) == 401
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("tree")]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    assert max(s.numTasks for s in stages if s) <= 8
    import hashlib

    digest = lambda t: hashlib.md5(((t or "") + "\n").encode()).hexdigest()
    wanted = [("src", "docs/a b")[i % 4] + digest(t) for i, t in rows if i is not None and i % 4 < 2]
    assert sorted(r.folder + r.digest for r in read.collect()) == sorted(wanted)


def test_commits_that_no_remote_ref_reaches(spark):
    rng = random.Random(9)
    history, heads, remotes, wanted = [], [], [], set()
    for repo in ("a", "b", "c", "d"):
        parents = {}
        for g in range(1, 40):
            below = sorted(parents, reverse=True)
            parents[g] = rng.sample(below[:5], min(len(below), rng.choice([1, 1, 2]))) if below else []
        history += [(repo, f"{repo}{g}", [f"{repo}{p}" for p in ps], g) for g, ps in parents.items()]
        ours, theirs = rng.sample(range(25, 40), 2), [] if repo == "d" else rng.sample(range(1, 40), 2)
        heads += [(repo, f"{repo}{g}") for g in ours]
        remotes += [(repo, f"{repo}{g}") for g in theirs] + [(repo, "unknown")]

        def reach(todo, parents=parents):
            todo, out = list(todo), set()
            while todo:
                g = todo.pop()
                if g not in out:
                    out.add(g)
                    todo += parents[g]
            return out

        wanted |= {(repo, f"{repo}{g}") for g in reach(ours) - reach(theirs)}
    frame = lambda rows: spark.createDataFrame(rows, "repo string, sha string")
    found = commits.unreachable_commits(spark.createDataFrame(history, "repo string, sha string, parents array<string>, generation int"), frame(heads), frame(remotes))
    assert {tuple(r) for r in found.collect()} == wanted
