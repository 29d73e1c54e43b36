"""Word text, run by run."""

import io
import tracemalloc
import zipfile

import pytest

from scrivia.sources.docx import iter_blocks

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"


def _file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NS}" xmlns:mc="{MC}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _texts(inner):
    return [b["text"] for b in iter_blocks(_file(f"<w:p>{inner}</w:p>"))]


BOX = "<w:drawing><w:txbxContent><w:p><w:r><w:t>BOX</w:t></w:r></w:p></w:txbxContent></w:drawing>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<w:r><w:t>ECR</w:t><w:noBreakHyphen/><w:t>P01</w:t></w:r>", "ECR-P01"),
        ("<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:cr/><w:t>d</w:t></w:r>", "a b c d"),
        ('<w:r><w:t>a</w:t><w:br w:type="page"/><w:t>b</w:t><w:br w:type="textWrapping"/><w:t>c</w:t></w:r>', "ab c"),
        ("<w:r><w:t>see </w:t></w:r><w:hyperlink><w:r><w:t>PLN-001</w:t></w:r></w:hyperlink><w:r><w:t>.</w:t></w:r>", "see PLN-001."),
        (f"<w:r><w:t>a</w:t></w:r><w:r>{BOX}</w:r><w:r><w:t>b</w:t></w:r>", "ab"),
        (f"<w:r><w:t>a</w:t><mc:AlternateContent><mc:Choice>{BOX}</mc:Choice><mc:Fallback>{BOX}</mc:Fallback></mc:AlternateContent></w:r>", "a"),
        ("<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t/></w:r>", ""),
    ],
)
def test_runs(inner, text):
    assert _texts(inner) == [text]


def test_blocks_keep_their_order():
    cell = "<w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr>{cell}</w:tr></w:tbl><w:p/><w:sectPr/>"
    assert [(b["text"], b["rows"]) for b in iter_blocks(_file(body))] == [("one", None), (None, [["x y"]]), ("", None)]


def test_memory_does_not_follow_the_body():
    content = _file("<w:p><w:r><w:t>a line of text</w:t></w:r></w:p>" * 200_000)
    tracemalloc.start()
    n = sum(1 for _ in iter_blocks(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 2_000_000
