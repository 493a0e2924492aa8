"""Schema rewrite, near vectors and ball k-means against brute force, with their edge cases."""

import datetime as dt
import glob
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import ball_kmeans, near_vectors, queries as registered, schema_rewrite

SMALL = "/root/testdata/sf0.001"
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, file_no int, rank long, _row long"


def crc(text):
    return zlib.crc32(text.encode())


def brute_rewrite(rows, narrow):
    """{file_no: (version, rows)} of dicts, after the rewrite. narrow: a double through a float."""
    rows = sorted(rows, key=lambda r: (r["client_id"] is None, r["client_id"] is not None and (crc(str(r["client_id"])), r["client_id"])))
    out = {}
    for r, row in enumerate(rows):
        n = r // (1 + len(rows) // 1000)
        v = crc(f"7:{n}") % 24
        v = v if v <= 15 else 0
        row = dict(row)
        if v & 4:
            row |= {"nation_id": -1, "city": "none"}
        if v & 8 and row["balance"] is not None:
            row["balance"] = narrow(row["balance"])
        out.setdefault(n, (v, []))[1].append(row)
    return out


def line(row):
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    cells = [{"updated_at": micros, "balance": lambda b: math.floor(1048576 * b)}.get(k, str)(row[k]) if row[k] is not None else "?" for k in schema_rewrite.COLUMNS]
    return "|".join(map(str, cells))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def start_names(v):
    names = list(schema_rewrite.COLUMNS)
    if v & 1:
        names[4], names[5] = names[5], names[4]
    if v & 4:
        names = [n for n in names if n not in ("city", "nation_id")]
    return ",".join([names[0], *names[:0:-1]] if v & 2 else names)


def hold(found, rows):
    want = brute_rewrite(rows, lambda b: float(np.float32(b)))
    got = {r.file_no: r for r in found}
    assert sorted(got) == sorted(want)
    for n, (v, own) in want.items():
        g = got[n]
        assert (g.version, g.n_rows, g.rewritten) == (v, len(own), v != 0)
        assert g.n_nulls == sum(r[k] is None for r in own for k in schema_rewrite.COLUMNS)
        assert g.ids_sha256 == sha(",".join("?" if r["client_id"] is None else str(r["client_id"]) for r in own))
        assert g.rows_sha256 == sha("\n".join(map(line, own)))
        assert (g.start_columns, g.columns) == (start_names(v), ",".join(schema_rewrite.COLUMNS))
        file = pq.ParquetFile(g.path.removeprefix("file://")).schema_arrow
        assert [int(f.metadata[b"PARQUET:field_id"]) for f in file] == list(range(1, 11)) and all(f.nullable for f in file)
        assert (str(file.field("nation_id").type), str(file.field("balance").type)) == ("int64", "double")
    if want:
        folder = os.path.dirname(next(iter(got.values())).path.removeprefix("file://"))
        files = [f for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f) and f.endswith(".parquet")]
        assert sorted(files) == sorted(g.path.removeprefix("file://") for g in got.values())


def test_rewrite_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/clients.parquet").collect()]
    found = registered.queries()["op11_rewrite_field_ids"](spark, SMALL).collect()
    hold(found, rows)
    assert {r.version for r in found} >= set(range(16))


def test_rewrite_many_rows_in_a_file(spark):
    rows = spark.range(2500).selectExpr("id AS client_id", "id AS master_id", "'é|' AS source", "CAST(NULL AS timestamp_ntz) AS updated_at", "if(id % 3 = 0, null, concat('n', id)) AS name", "'' AS email", "'c' AS city", "CAST(id % 7 AS int) AS nation_id", "'s' AS segment", "id / 7.0D - 100 AS balance")
    hold(schema_rewrite.rewritten_clients(rows).collect(), [r.asDict() for r in rows.collect()])


def test_rewrite_edges(spark):
    full = (1, dt.datetime(2024, 1, 1, 0, 0, 0, 7), "n" * 100_000, "e", None)
    rows = [(i, i, "s", t, name, e, c, 3, "x", -0.1 * i, 1, 2, 3) for i in range(40) for _, t, name, e, c in [full]]
    rows += [rows[5], (None,) * 13]
    df = spark.createDataFrame(rows, SCHEMA)
    hold(schema_rewrite.rewritten_clients(df).collect(), [r.asDict() for r in df.collect()])
    assert schema_rewrite.rewritten_clients(df.limit(0)).count() == 0


def test_rewrite_again_changes_nothing(spark):
    df = spark.read.parquet(f"{SMALL}/clients.parquet")
    [path] = {os.path.dirname(r.path) for r in schema_rewrite.rewritten_clients(df).collect()}
    before = sorted(os.listdir(path.removeprefix("file://")))
    schema_rewrite.rewrite(spark, path, schema_rewrite.evolved_schema(df), schema_rewrite.DEFAULTS)
    assert sorted(os.listdir(path.removeprefix("file://"))) == before


def brute_near(rows, least=0.98):
    """[(vec_id, n_links, component_id)] in order of rows."""
    units = []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v] if v is not None else [], float)
        norm = np.linalg.norm(x)
        units.append(x / norm if label is not None and len(x) and np.isfinite(norm) and norm > 0 else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    # rows of one id that link nothing stay apart; classes follow links only
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        part, stack = [], [i]
        seen.add(i)
        while stack:
            a = stack.pop()
            part.append(a)
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        least_id = min((rows[a][0] for a in part if rows[a][0] is not None), default=None)
        for a in part:
            out[a] = (rows[a][0], len(near[a]), least_id)
    return out


def by_text(rows):
    return sorted(map(repr, rows))


def vectors(n_groups, per, dim, seed, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, dim))
    return [(centres[g] + noise * rng.normal(size=dim)).tolist() for g in range(n_groups) for _ in range(per)]


@pytest.mark.parametrize("cell", [512, 20])
def test_near_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(near_vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(near_vectors, "BLOCK", cell)
    v = vectors(60, 6, 8, 3, 0.12) + vectors(1, 150, 8, 4, 0.05)  # many pairs near the threshold, and one large group
    rows = [(i, x, i % 2) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df).collect()
    want = brute_near(rows)
    assert 300 < sum(n for _, n, _ in want)
    assert by_text((r.vec_id, r.n_links, r.component_id) for r in got) == by_text(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_cells_meet_all_partners(spark, monkeypatch):
    """Each linked pair meets in the home cell of one, also where a border runs between them."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 40)
    v = np.array(vectors(8, 100, 4, 9, 0.5))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    distinct = spark.createDataFrame([(1, i, 1, bytearray(x.tobytes())) for i, x in enumerate(u)], "label int, rid long, weight long, v binary").withColumn("digest", F.md5("v"))
    cells = near_vectors.fit_cells(distinct, 0.98, "<f8")
    placed = near_vectors.to_cells(distinct, cells, 0.98, "<f8").collect()
    home, there = {r.rid: r.cell for r in placed if r.home}, {(r.rid, r.cell) for r in placed}
    assert len(home) == len(u) and len(set(home.values())) > 3 and len(placed) > len(u)
    a, b = np.nonzero(u @ u.T >= 0.98)
    assert any(home[i] != home[j] for i, j in zip(a.tolist(), b.tolist()))
    assert all((i, home[j]) in there or (j, home[i]) in there for i, j in zip(a.tolist(), b.tolist()))


def test_near_vectors_edges(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (2, b, 1), (3, b, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [1.0, float("nan"), 0.0], 1),
        (10, [1.0, 0.0], 1), (None, a, 1), (None, b, 2), (None, [0.0, 1.0, 0.0], 3), (11, [1e200, 0.0, 0.0], 1), (12, [float("inf"), 0.0, 0.0], 1), (13, [5.0, 0.0, 0.0], 1), (14, [-1.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, rid string, cell int")
    got = near_vectors.near_vectors(df).collect()
    assert by_text((r.vec_id, r.n_links, r.component_id) for r in got) == by_text(brute_near([(i, [1.0, 0.0, 0.0] if i == 11 else v, l) for i, v, l in rows]))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
    kept = near_vectors.keep_one_vector(df)
    assert kept.columns == df.columns and {r.vec_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, None}


def brute_kmeans(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, i) in zip(kept, of) if i == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    of = assign()
    sums = [sum(d for d, i in of if i == j) for j in range(len(c))]
    return [(i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, of)]


def test_ball_kmeans_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = registered.queries()["op13_centroids_ball_kmeans"](spark, SMALL).collect()
    assert by_text(map(tuple, got)) == by_text(brute_kmeans(rows))


def test_ball_kmeans_ties_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(0, 2, 64) / 64).tolist()) for i in range(300)]  # a lattice: many exact ties, tight and loose balls
    rows += [(i, (3 + rng.integers(0, 2, 64) / 64).tolist()) for i in range(300, 400)]
    rows += [(1, rows[1][1]), (None, rows[3][1]), (500, None), (501, [1.0] * 63), (502, [None] + [1.0] * 63), (503, [float("nan")] * 64), (504, [float("-inf")] * 64), (505, []), (506, [-1e5] * 64)]
    df = spark.createDataFrame([(*r, 7, "b") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    assert by_text(map(tuple, ball_kmeans.clustered(df).collect())) == by_text(brute_kmeans(rows))
    few = df.where("vec_id < 3")
    assert by_text(map(tuple, ball_kmeans.clustered(few).collect())) == by_text(brute_kmeans([r for r in rows if r[0] is not None and r[0] < 3]))
    assert ball_kmeans.clustered(df.where("vec_id > 500 and vec_id < 506")).count() == 0
    far = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], "vec_id long, embedding array<double>")
    assert [r.distance for r in ball_kmeans.clustered(far).collect()] == [0, 0]


def test_balls_compare_few():
    """The stable core is compared with its own centroid only, and annuli with the neighbours that can win."""
    rng = np.random.default_rng(6)
    c = rng.integers(-200, 200, (16, 64))
    x = (c[rng.integers(0, 16, 3000)] + rng.integers(-90, 90, (3000, 64)) * (rng.random((3000, 1)) < 0.4)).astype(np.int32)
    cluster, least = ball_kmeans.nearest(x, c)
    balls = ball_kmeans.Balls(c, np.array([least[cluster == i].max(initial=-1) for i in range(16)]))
    assert min(len(n) for n, _ in balls.near) < 15
    moved = c + rng.integers(-25, 25, c.shape)
    far = np.array([ball_kmeans.squared(x[cluster == i], moved[i : i + 1]).max(initial=-1) for i in range(16)])
    got, want = ball_kmeans.Balls(moved, far).assign(x, cluster), ball_kmeans.nearest(x, moved)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
