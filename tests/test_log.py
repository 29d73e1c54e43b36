"""The commit log: several writers, snapshots, appended batches, merging and cleaning."""

import threading
import zipfile

from scrivia.plans import log
from scrivia.plans.api import Tools
from scrivia.plans.index import build_index, open_index, set_meta
from scrivia.streaming.ingest import append

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def _values(df):
    return sorted(r.v for r in df.collect())


def test_writers_lose_nothing_and_readers_keep_their_state(spark, tmp_path):
    path = str(tmp_path / "index")
    assert log.state(spark, path) is None
    first = log.commit(spark, path, lambda seen: log.Change(anew={"a": _frame(spark, 1), "sum": _frame(spark, 1)}))
    reader = log.opened(spark, path, first.tables)
    calls = []

    def slow(seen):
        calls.append(seen.number)
        if len(calls) == 1:  # another writer comes between: adds to one table and writes the other anew
            log.commit(spark, path, lambda s: log.Change(more={"a": _frame(spark, 2)}, anew={"sum": _frame(spark, 3)}))
        total = sum(_values(log.opened(spark, path, seen.tables)["sum"]))
        return log.Change(more={"a": _frame(spark, 4)}, anew={"sum": _frame(spark, total + 4)})

    log.commit(spark, path, slow)
    now = log.opened(spark, path, log.state(spark, path).tables)
    # written anew from an older state, the sum was made again; both additions are there
    assert _values(now["a"]) == [1, 2, 4] and _values(now["sum"]) == [7] and calls == [0, 1]
    assert _values(reader["a"]) == [1] and _values(reader["sum"]) == [1]
    # additions alone are never made again
    seen = []

    def adding(s):
        seen.append(s.number)
        if len(seen) == 1:
            log.commit(spark, path, lambda t: log.Change(more={"a": _frame(spark, 8)}))
        return log.Change(more={"a": _frame(spark, 16)})

    log.commit(spark, path, adding)
    assert len(seen) == 1 and _values(log.opened(spark, path, log.state(spark, path).tables)["a"]) == [1, 2, 4, 8, 16]
    # merged into one folder; what no commit names goes
    assert log.compacted(spark, path, most=2) == ["a"]
    state = log.state(spark, path)
    assert len(state.tables["a"]) == 1 and _values(log.opened(spark, path, state.tables)["a"]) == [1, 2, 4, 8, 16]
    assert len(log.cleaned(spark, path)) >= 6 and log.cleaned(spark, path) == []
    assert _values(log.opened(spark, path, log.state(spark, path).tables)["a"]) == [1, 2, 4, 8, 16]


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "index")
    log.commit(spark, path, lambda seen: log.Change(anew={"sum": _frame(spark, 0)}))

    def add(n):
        log.commit(spark, path, lambda s: log.Change(anew={"sum": _frame(spark, _values(log.opened(spark, path, s.tables)["sum"])[0] + n)}))

    threads = [threading.Thread(target=add, args=(10**i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert _values(log.opened(spark, path, log.state(spark, path).tables)["sum"]) == [1111] and log.state(spark, path).number == 4


def _docx(path, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NS}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')


def test_appended_batches_equal_a_rebuild(spark, tmp_path):
    grown, rebuilt = str(tmp_path / "grown"), str(tmp_path / "rebuilt")
    every = tmp_path / "every"
    every.mkdir()
    batches = []
    texts = ["bolt and screw", "bolt bolt", "", "screws tested", "a test of bolts and nuts", "nut"]
    for b in range(3):
        folder = tmp_path / f"batch{b}"
        folder.mkdir()
        batches.append(folder)
        for i in (0, 1):
            n = 2 * b + i
            for to in (folder, every):
                _docx(to / f"ECR-{n:03d} - Change {n}_{'AB'[n % 2]}.docx", texts[n])
    build_index(spark, str(batches[0]), grown)
    set_meta(spark, grown, "note", "kept")
    read = lambda folder: spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(str(folder))
    assert [append(spark, grown, read(b)) for b in (batches[1], batches[2], batches[1])] == [2, 2, 0]
    build_index(spark, str(every), rebuilt)

    def same():
        a, b = open_index(spark, grown), open_index(spark, rebuilt)
        for name, keys in (("documents", ["doc_id", "revision", "content_hash"]), ("chunks", ["chunk_id", "text"]), ("postings", ["term", "chunk_id", "tf", "dl"]), ("defaults", ["doc_id", "revision", "is_current"])):
            assert sorted(map(tuple, a[name].select(*keys).collect())) == sorted(map(tuple, b[name].select(*keys).collect())), name
        x, y = a["figures"].first(), b["figures"].first()
        assert x.total == y.total == 5 and abs(x.avgdl - y.avgdl) < 1e-12
        for ask in ("bolt", "screw tests", "nut bolts"):
            found = [[(r["chunk_id"], r["is_current"]) for r in Tools(i).search_content(ask)["results"]] for i in (a, b)]
            assert found[0] == found[1] and found[0]

    same()
    assert {"postings", "blocks"} <= set(log.compacted(spark, grown, most=2))
    log.cleaned(spark, grown)
    same()
    assert open_index(spark, grown)["meta"].where("key = 'note'").first().value == "kept"
