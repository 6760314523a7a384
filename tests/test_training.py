"""Warm starts, early stops, workbooks and routed writes."""

import io
import random
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest

from tamarisk.operators import labels, profile, training
from tamarisk.sources import files, workbook
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def posts(spark):
    """Two vocabularies of insults: the second half of the rows uses the second one."""
    rng = random.Random(6)
    calm = ["day", "walk", "tea", "rain", "bread", "friend", "book", "lamp"]
    bad = [["idiot", "moron"], ["clown", "donkey"]]
    rows = []
    for k in range(600):
        toxic = rng.random() < 0.4
        words = [rng.choice(calm) for _ in range(rng.randint(3, 9))] + ([rng.choice(bad[k // 300])] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words) + f" n{k}", int(toxic)))
    rows += [(900, None, 1), (901, "no label", None), (902, "", 0)]
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(3)


def loss(df, model):
    return training.scored(df, model).where("label IN (0, 1)").select(F.avg(-F.log(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")))).alias("x")).first().x


def test_continued_fit(spark, posts, tmp_path):
    """Going on from given weights improves on new rows, keeps the old ones, and is the same to the bit on another partitioning."""
    old, new = posts.where("id < 300 OR id >= 900"), posts.where("id BETWEEN 300 AND 599")
    first = training.fit(old, features=1 << 10, passes=15)
    assert loss(old, first) < 0.4 < loss(new, first)
    second = training.fit(posts, first, passes=15)
    assert loss(new, second) < loss(new, first) - 0.1 and loss(old, second) < 0.5
    # the first measure of the second fit is that of the weights it was given
    assert second.history[0][1] > second.history[second.best][1]
    again = training.fit(posts.repartition(7), first, passes=15)
    assert np.array_equal(again.weights, second.weights) and again.bias == second.bias and again.history == second.history
    training.save(spark, second, str(tmp_path / "m"))
    back = training.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.weights, second.weights) and back.bias == second.bias


def test_gradient(posts):
    """A pass' sums against the formula over all rows."""
    model = training.Model(np.random.default_rng(1).normal(size=64), 0.3)
    rows = training.hashed(posts.where("label IS NOT NULL"), 64).select(F.col("label").cast("double").alias("label"), F.lit(2.0).alias("weight"), (F.col("id") % 5 == 0).alias("held"), "words")
    told = training._pass(rows, model)
    slope, held_loss = np.zeros(65), 0.0
    for r in rows.collect():
        x = np.bincount(r.words, minlength=64) / max(len(r.words), 1) ** 0.5
        m = x @ model.weights + model.bias
        if r.held:
            held_loss += 2 * (np.log1p(np.exp(m)) - r.label * m)
        else:
            e = 2 * (1 / (1 + np.exp(-m)) - r.label)
            slope += np.append(e * x, e)
    assert np.allclose(told[5:], slope[:-1], atol=1e-5) and np.isclose(told[training.BIAS], slope[-1], atol=1e-5) and np.isclose(told[training.HELD_LOSS], held_loss, atol=1e-5)


def test_early_stop(spark):
    """Labels without any pattern: the held-out loss soon rises, the fit ends before its passes and returns the best pass."""
    rng = random.Random(9)
    rows = [(" ".join(f"w{rng.randrange(40)}" for _ in range(6)), rng.randrange(2)) for _ in range(300)]
    model = training.fit(spark.createDataFrame(rows, "text string, label int"), features=1 << 12, passes=40, rate=2.0, held_out=0.3)
    assert len(model.history) < 41 and len(model.history) == model.best + 1 + training.PATIENCE
    assert model.history[model.best][1] == min(h for _, h in model.history)
    assert training.fit(spark.createDataFrame([], "text string, label int"), features=8).best == 0


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, tables):
    """A workbook of {name: rows}: strings shared, inline or plain by turns, cells of None left out."""
    shared, parts = [], []
    for rows in tables.values():
        lines = []
        for i, row in enumerate(rows, 1):
            cells = ""
            for j, v in enumerate(row):
                ref = f'r="{chr(65 + j)}{i}"'
                if isinstance(v, bool):
                    cells += f'<c {ref} t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, (int, float)):
                    cells += f"<c {ref}><v>{v}</v></c>"
                elif v is not None and j % 2:
                    cells += f'<c {ref} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                elif v is not None:
                    shared.append(v)
                    cells += f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>'
            lines.append(f'<row r="{i}">{cells}</row>')
        parts.append(f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" for s in shared) + "</sst>")
        for k, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", part)
    path.write_bytes(out.getvalue())


def test_workbook(spark, tmp_path):
    """Four sheets by name, with and without a header, joined by name, a task each."""
    path = tmp_path / "data.xlsx"
    tables = {
        "Twitter": [["text", "label"], ["hello & <co>", 1], ["نص عربي", 0]],
        "Forum": [["label", "text", "note"], ["yes", "other order", True], [None, "no label"]],
        "Empty": [["text", "label"]],
        "Bare": [["first", "a"], [None, "b"], [3.5, None]],
    }
    book(path, tables)
    four = workbook.read_workbook(spark, str(path), ["Twitter", "Forum", "Empty"])
    assert four.columns == ["text", "label", "note"]
    assert sorted(map(tuple, four.collect()), key=str) == sorted([("hello & <co>", "1", None), ("نص عربي", "0", None), ("other order", "yes", "True"), ("no label", None, None)], key=str)
    assert four.rdd.getNumPartitions() == 3
    bare = files.read_table(spark, str(path), no_header=True, columns=["text", "label"], sheet="Bare")
    assert sorted(map(tuple, bare.collect()), key=str) == sorted([("first", "a"), (None, "b"), ("3.5", None)], key=str)
    assert [r.text for r in files.read_table(spark, str(path)).orderBy("text").collect()] == ["hello & <co>", "نص عربي"]
    assert {(r.number, r.sheet) for r in workbook.sheets(spark, str(path)).collect()} == set(enumerate(tables))
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read_workbook(spark, str(path), ["Nowhere"])


def test_routed_write(spark, tmp_path):
    """Counts and routes of one scan."""
    rows = [(1, "abc", 1), (2, None, 1), (3, "a", 0), (4, "abcd", None), (5, "long enough", 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    steps = [("text", F.col("text").isNotNull()), ("label", F.col("label").isNotNull()), ("length", F.length("text") >= 3)]
    told = labels.write_routed(df, str(tmp_path / "out"), steps)
    assert told == {"raw": 5, "text": 4, "label": 3, "length": 2}
    assert {(r.id, r.route) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "kept"), (2, "text"), (3, "length"), (4, "label"), (5, "kept")}
    assert [(r.step, r.n) for r in profile.funnel(df, steps).orderBy("place").collect()] == list(told.items())
