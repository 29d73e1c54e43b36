"""The four calls as functions of an opened index, returning JSON-able records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.functions.stemming import stem
from scrivia.functions.text import normal_id
from scrivia.operators import catalog, content, early_stop, reading, references, vectors

# The records' keys (error, note, closest_matches, no_current_revision, is_empty, too_large, truncated, ...).


class Tools:
    """``index``: the tables of ``open_index``; ``embed`` maps a list of texts to vectors."""

    def __init__(self, index: dict[str, DataFrame], embed: Callable | None = None):
        self.index, self.embed = index, embed

    def search_catalog(self, query: str | None = None, doc_type: str | None = None, status: str | None = None, sw_version: str | None = None) -> dict:
        try:
            rows = catalog.search_catalog(self.index["documents"], query, doc_type, status, sw_version).collect()
        except ValueError as e:
            return {"error": str(e)}
        out = {"count": len(rows), "documents": [r.asDict(recursive=True) for r in rows]}
        if query and not rows:
            out["closest_matches"] = self._near(query)
            out["note"] = "nothing reaches the threshold; the nearest documents are listed for a guess"
        return out

    def _near(self, query: str) -> list[dict]:
        return [{"doc_id": r["doc_id"], "title": r["title"]} for r in catalog.closest_matches(self.index["documents"], query).collect()]

    def search_content(self, query: str, mode: str = "keyword", top_k: int = 10, include_superseded: bool = False) -> dict:
        i = self.index
        if mode == "semantic":
            if "embeddings" not in i or self.embed is None:
                return {"error": "this index holds no vectors to compare with", "note": "run backfill_embeddings first, or search by keyword"}
            rows = self._nearest([float(x) for x in self.embed([query])[0]], top_k, include_superseded)
            return {"count": len(rows), "mode": mode, "results": rows}
        elif mode == "keyword":
            terms = [stem(t.lower()) for t in re.findall(r"[A-Za-z0-9]+", query)]
            if not terms:
                return {"error": "the query has no letters or digits to look for"}
            asked = i["documents"].sparkSession.createDataFrame([(0, terms)], "q long, terms array<string>")
            best = early_stop.top_k(early_stop.Blocks(i["directory"], i["blocks"]), i["figures"], asked, top_k, None if include_superseded else i["defaults"])
            scores = best.select("chunk_id", "score")
        else:
            return {"error": f"mode is 'keyword' or 'semantic', not {mode!r}"}
        found = content.assemble(scores, i["chunks"], i["documents"], i["defaults"], top_k, include_superseded)
        rows = found.drop("score").collect()
        return {"count": len(rows), "mode": mode, "results": [r.asDict() for r in rows]}

    def _nearest(self, vector: list[float], top_k: int, include_superseded: bool) -> list[dict]:
        i = self.index
        held = vectors.opened(i["vector_pivots"], i["vector_blocks"])
        asked = i["documents"].sparkSession.createDataFrame([(0, vector)], "q long, embedding array<double>")
        depth = 4 * top_k
        while True:  # deeper into the order until what may be shown fills the answer
            near = vectors.search(held, asked, depth).select(F.col("id").alias("chunk_id"), (-F.col("score")).alias("score"))
            found = content.assemble(near, i["chunks"], i["documents"], i["defaults"], top_k, include_superseded).drop("score").collect()
            if len(found) == top_k or near.count() < depth:
                return [r.asDict() for r in found]
            depth *= 8

    def read_document(self, doc_id: str, revision: str | None = None, section: str | None = None) -> dict:
        row = reading.locate(catalog.chains(self.index["documents"]), doc_id, revision).first()
        if row["outcome"] == "unknown":
            close = self.search_catalog(doc_id)["documents"][:3]
            return {"error": f"{doc_id!r} names no single document", "closest_matches": [{"doc_id": c["doc_id"], "title": c["title"]} for c in close] or self._near(doc_id)}
        out = {"doc_id": row["doc_id"], "revisions": [{k: v for k, v in r.asDict().items() if k != "n"} for r in row["revisions"]]}
        if row["outcome"] == "obsolete":
            return out | {"no_current_revision": True, "note": "all revisions are obsolete; name one to read it all the same"}
        if row["outcome"] == "no revision":
            return out | {"error": f"{row['doc_id']} has no revision {row['wanted']!r}"}
        out |= {"revision": row["wanted"], "title": row["info"]["title"], "is_obsolete": row["info"]["is_obsolete"]}
        if row["outcome"] == "empty":
            return out | {"is_empty": True, "note": "the file is in the collection, but has no text"}
        rows = self.index["chunks"].where((F.col("doc_id") == row["doc_id"]) & (F.col("revision") == row["wanted"]))
        got = reading.contents(rows, section).first()
        if got is None or got["outcome"] == "too large":
            out["sections"] = [{"section": r["section"], "chars": r["chars"]} for r in reading.outline(rows).orderBy("first").collect()]
            if got is None:
                return out | {"error": f"no heading contains {section!r}"}
            return out | {"too_large": True, "char_count": got["char_count"], "note": "too long for one answer; ask for a section of the list"}
        out |= {"char_count": got["char_count"], "text": got["text"]}
        if got["truncated"]:
            out |= {"truncated": True, "note": f"{got['included']} of {got['char_count']} characters; a narrower section or search_content finds the rest"}
        return out

    def get_references(self, doc_id: str, direction: str = "both") -> dict:
        documents = self.index["documents"]
        known = documents.where(normal_id("doc_id") == normal_id(F.lit(doc_id))).select("doc_id").first()
        try:
            frames = references.get_references(self.index["refs"], documents, doc_id, direction)
        except ValueError as e:
            return {"error": str(e)}
        if known is None:
            return {"error": f"{doc_id!r} is not in the catalog"}
        shown = {
            "references": lambda r: {"doc_id": r.to_doc, "mentions": r.mentions, "resolved": r.resolved, "context": r.context},
            "cited_by": lambda r: {"doc_id": r.from_doc, "revision": r.from_rev, "mentions": r.mentions, "context": r.context},
        }
        return {"doc_id": known[0], **{k: [shown[k](r) for r in f.collect()] for k, f in frames.items()}}
