import random
import sqlite3

from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.functions.stemming import stem
from scrivia.operators import chunking

# File names and the fields they parse to.
NAMES = {
    "BOM-055 - MX1 Top-level assembly_G.docx": ("BOM-055", "G", "MX1 Top-level assembly", False, False, False),
    "VVPR-P01-151 - Half  Layer Protocol_B-signed.docx": ("VVPR-P01-151", "B", "Half Layer Protocol", True, False, False),
    "ECR-577 - Change_E_Obsolete.docx": ("ECR-577", "E", "Change", False, True, False),
    "ESF-010 - Spec_B - Signed.docx": ("ESF-010", "B", "Spec", True, False, False),
    "IFU-MX1 - Instructions_C-Signed.docx": ("IFU-MX1", "C", "Instructions", True, False, False),
    "3P-P01-33 - Report_B(1).docx": ("3P-P01-33", "B", "Report", False, False, True),
    "PLN-001- Plan.docx": ("PLN-001", None, "Plan", False, False, False),
    "PLN-002 Plan two_A.docx": ("PLN-002", "A", "Plan two", False, False, False),
    "RSK-003 - a_b c_A.docx": ("RSK-003", "A", "a_b c", False, False, False),
}


def test_filenames(spark):
    df = T.parse_filename(spark.createDataFrame([(n,) for n in NAMES], "filename string"))
    for r in df.collect():
        assert (r.doc_id, r.revision, r.title, r.is_signed, r.is_obsolete, r.is_duplicate) == NAMES[r.filename]
    odd = T.parse_filename(spark.createDataFrame([("random notes final v2.docx",), ("BOM-1 - t v4.0.0-rc_A-Draft.docx",)], "filename string")).collect()
    assert odd[0].doc_id is None
    assert odd[1].warning == "unknown status suffix 'Draft'" and odd[1].revision == "A" and odd[1].sw_version == "v4.0.0-rc"


def test_indel_ratio_matches_direct_lcs(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(0, 8))), "".join(rng.choices("abcd", k=rng.randint(0, 8)))) for _ in range(60)]

    def ratio(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            cur = [0]
            for j, y in enumerate(b):
                cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[-1]))
            prev = cur
        return 200 * prev[-1] / (len(a) + len(b)) if a or b else 100.0

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("r")).collect()
    assert all(abs(r.r - ratio(r.a, r.b)) < 1e-9 for r in got)


def test_porter_matches_fts5():
    words = "verification verify verified running hopping falling agreed plastered motoring conflated sized happy relational conditional rational triplicate hopeful goodness revival adjustment controlling rate cease roll electricity ponies caress cats feed sky".split()
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    for i, w in enumerate(words):
        c.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i + 1, w))
    stems = dict(c.execute("SELECT doc, term FROM v"))
    assert {w: stem(w) for w in words} == {w: stems[i + 1] for i, w in enumerate(words)}


def _fold(spark, items, limit=2000):
    df = spark.createDataFrame([(items,)], "items array<struct<level:int,kind:string,text:string>>")
    return df.select(chunking.chunk_pack(chunking.section_fold("items"), limit).alias("c")).first().c


def test_chunks_at_the_limit_and_level_skip(spark):
    assert len(_fold(spark, [(None, "text", "x" * 1000), (None, "text", "y" * 1000)])) == 1
    assert len(_fold(spark, [(None, "text", "x" * 1000), (None, "text", "y" * 1001)])) == 2
    got = _fold(spark, [(1, "text", "A"), (3, "text", "B"), (None, "text", "one"), (3, "text", "C"), (None, "table", "two")])
    assert [c.section_path for c in got] == ["A > B", "A > B > C"]
    assert _fold(spark, [(1, "text", "A")]) == []


def test_table_blocks(spark):
    t = lambda rows, n=4000: spark.createDataFrame([(rows,)], "r array<array<string>>").select(chunking.table_blocks(F.col("r"), n).alias("b")).first().b
    assert t([["a", "b"]]) == ["| a | b |\n| --- | --- |"]
    assert t([["", ""]]) == []
    head = "| h |\n| --- |"
    assert t([["h"], ["x" * 50], ["y" * 50]], 60) == [f"{head}\n| {'x' * 50} |", f"{head}\n| {'y' * 50} |"]
