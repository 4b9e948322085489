"""Sealed versions: what was changed is named by version and path; roots against a fold by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import provenance

VERSIONS = "project_id string, number int, version_id string, directive string, replacement string"
FILES = "version_id string, path string, digest string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def root_brute(files, fan):
    level = [sha(f"{len(p.encode())}:{p}{d or ''}") for p, d in sorted(files)]
    while len(level) > 1:
        parts = [level[k : k + fan] for k in range(0, len(level), fan)]
        level = [p[0] if len(p) == 1 else sha("".join(p)) for p in parts]
    return level[0]


@pytest.mark.parametrize("fan", [2, 3, 1000])
def test_roots(spark, fan):
    files = {v: [(f"é/{k:03d}", f"d{k}" if k % 5 else None) for k in range(n)] for v, n in (("a", 1), ("b", 2), ("c", 17))}
    rows = spark.createDataFrame([(v, *f) for v, fs in files.items() for f in reversed(fs)], FILES).repartition(3)
    got = {r.version_id: (r.root, r.n) for r in provenance.roots(rows, fan).collect()}
    assert got == {v: (root_brute(fs, fan), len(fs)) for v, fs in files.items()}
    assert provenance.roots(rows.limit(0)).count() == 0


@pytest.fixture
def project(spark):
    versions = [("p", k, f"p{k}", f"do {k}", f"new {k}") for k in range(1, 6)] + [("q", 1, "q1", None, None)]
    files = [(v[2], f"f{j}", f"{v[2]}-{j}") for v in versions[:5] for j in range(4)]
    manifest = spark.createDataFrame(files, FILES)
    return provenance.sealed(spark.createDataFrame(versions, VERSIONS).repartition(3), manifest, 3), manifest


def problems(versions, manifest, artifacts):
    return sorted((r.version_id, r.path or "", r.problem) for r in provenance.verified(versions, manifest, artifacts, 3).collect())


def after(*versions):
    return [(v, "", "derived from a broken version") for v in versions]


def test_nothing_changed(project):
    versions, manifest = project
    assert problems(versions, manifest, manifest) == []
    rows = {r.version_id: r for r in versions.collect()}
    assert rows["p1"].parent_seal is None and rows["p2"].parent_seal == rows["p1"].seal and rows["q1"].root == provenance.NO_ROOT


def test_changes_are_named(spark, project):
    versions, manifest = project
    at = lambda v, p: (F.col("version_id") == v) & (F.col("path") == p)
    changed = manifest.withColumn("digest", F.when(at("p3", "f2"), "other").otherwise(F.col("digest"))).where(~at("p4", "f0"))
    changed = changed.unionByName(spark.createDataFrame([("q1", "new", "x")], FILES))
    got = problems(versions, manifest, changed)
    assert got == sorted([("p3", "f2", "artifact changed"), ("p4", "f0", "artifact missing"), ("q1", "new", "artifact added"), *after("p4", "p5")])
    # the manifest is changed along with the artifact
    assert problems(versions, changed, changed) == sorted([("p3", "", "manifest changed"), ("p4", "", "manifest changed"), ("q1", "", "manifest changed"), *after("p4", "p5")])


@pytest.mark.parametrize(("column", "problem"), [("directive", "directive changed"), ("replacement", "replacement changed")])
def test_directives(project, column, problem):
    versions, manifest = project
    got = problems(versions.withColumn(column, F.when(F.col("number") == 4, "z").otherwise(F.col(column))), manifest, manifest)
    assert got == sorted([("p4", "", problem), *after("p5")])


def test_seals(project):
    versions, manifest = project
    got = problems(versions.withColumn("seal", F.when(F.col("version_id") == "p2", "z").otherwise(F.col("seal"))), manifest, manifest)
    assert got == sorted([("p2", "", "seal changed"), ("p3", "", "parent is another"), *after("p3", "p4", "p5")])
    got = problems(versions.where("version_id <> 'p2'"), manifest.where("version_id <> 'p2'"), manifest.where("version_id <> 'p2'"))
    assert got == sorted([("p3", "", "parent is another"), *after("p4", "p5")])


def test_few_and_many_artifacts_against_a_fold_by_hand(spark):
    rnd = random.Random(3)
    was, now = {}, {}
    for k in range(24):
        v, n = f"v{k:02d}", rnd.choice((0, 1, 3, 4, 9))
        was[v] = {f"f{j}": rnd.choice(("a", "", None)) for j in range(n)}
        now[v] = dict(was[v])
        for _ in range(rnd.choice((0, 0, 2, 4))):
            path = f"f{rnd.randrange(n + 2)}"
            if rnd.random() < 0.4:
                now[v].pop(path, None)
            else:
                now[v][path] = rnd.choice(("a", "", None))
    rows = lambda held: spark.createDataFrame([(v, *f) for v, fs in held.items() for f in fs.items()], FILES).repartition(3)
    versions = [(f"p{k % 2}", k, v, "do", None) for k, v in enumerate(was)]
    want, broken = [], set()
    for project, _, v, *_ in versions:
        of_v = [("artifact missing" if p not in now[v] else "artifact added" if p not in was[v] else "artifact changed", p) for p in was[v] | now[v] if (p in was[v], was[v].get(p)) != (p in now[v], now[v].get(p))]
        want += [(v, p, problem) for problem, p in of_v] + after(*[v] * (project in broken))
        broken |= {project} if of_v else set()
    sealed = provenance.sealed(spark.createDataFrame(versions, VERSIONS), rows(was), 3)
    assert {x[2] for x in want} == {"artifact missing", "artifact added", "artifact changed", "derived from a broken version"}
    assert problems(sealed, rows(was), rows(now)) == sorted(want)


def test_artifacts_that_lie_together_are_not_shuffled(spark):
    def shuffled():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    n = spark.range(2_000).select(F.col("id").alias("version_id")).repartition(4, "version_id")
    files = n.select("version_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k")).select("version_id", F.col("k").cast("string").alias("path"), F.md5(F.concat_ws("-", "version_id", "k")).alias("digest"))
    before = shuffled()
    assert provenance.roots(files).where("root is not null and n = 30").count() == 2_000
    assert shuffled() - before < 10 * 60_000  # 60,000 artifacts, of 32 bytes at least
