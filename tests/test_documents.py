"""PDF and word-processor documents through a build, and the commit log source."""

import subprocess
import zipfile
import zlib

from tessera.operators import increment
from tessera.sources import commits, files, pdf
from tessera.sources.store import Store


def made(pages, packed=False, fonts=b""):
    """A PDF file of pages' content streams; packed: page objects in an object stream, Flate."""
    deflate = lambda b: zlib.compress(b) if packed else b
    flag = b" /Filter /FlateDecode" if packed else b""
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages)))
    small = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(pages)}
    small |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % (100 + i) for i in range(len(pages))}
    small[5] = b"<< /Type /Font " + fonts + b">>"
    out = b"%PDF-1.5\n"
    if packed:
        at, bodies = [], b""
        for n, body in small.items():
            at.append(b"%d %d" % (n, len(bodies)))
            bodies += body + b" "
        head = b" ".join(at) + b" "
        stream = zlib.compress(head + bodies)
        out += b"3 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(small), len(head), len(stream)) + stream + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in small.items())
    for i, p in enumerate(pages):
        body = deflate(p)
        out += b"%d 0 obj << /Length %d%s >> stream\r\n" % (100 + i, len(body), flag) + body + b"\nendstream\nendobj\n"
    table = zlib.compress(b"1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    return out + b"50 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % len(table) + table + b"\nendstream endobj\ntrailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"BT /F1 12 Tf 72 700 Td (1. INTRODUCTION) Tj 0 -14 Td [(Some wo) -20 (rds \(all\)) -300 (that)] TJ T* (matter\054 here \351) ' ET"


def test_pdf_text():
    want = "1. INTRODUCTION\nSome words (all) that\nmatter, here é"
    assert pdf.text_of(made([PAGE])) == want == pdf.text_of(made([PAGE], packed=True))
    many = made([b"BT (p%d) Tj ET" % i for i in range(30)], packed=True)
    assert pdf.text_of(many) == "\n".join(f"p{i}" for i in range(20))
    coded = made([b"BT /F1 9 Tf <0003001000110012> Tj ET"], fonts=b"/ToUnicode 50 0 R ")
    assert pdf.text_of(coded) == "Aabc"
    assert pdf.text_of(b"no pdf") is None and pdf.text_of(b"") is None
    assert pdf.text_of(made([PAGE]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")) is None
    cut = made([PAGE], packed=True)
    for n in range(0, len(cut), 37):  # broken anywhere: never an error
        assert pdf.text_of(cut[:n]) in (None, "", want)
    assert pdf.text_of(b"%PDF-1.4 " + bytes(range(256)) * 50) == ""


def test_documents_in_a_build(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    long = PAGE.replace(b"matter", b"matter a lot to whoever reads them")
    (root / "paper.pdf").write_bytes(made([long, b"BT (RELATED WORK) Tj ET"], packed=True))
    (root / "scan.pdf").write_bytes(made([b"q 1 0 0 1 0 0 cm /Im0 Do Q"]))
    (root / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    with zipfile.ZipFile(root / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One &amp; all</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p>')
    (root / "b.docx").write_bytes(b"no zip")
    (root / "c.md").write_text("# Ünïcode\n")
    s = Store(spark, str(tmp_path / "g"))
    change = increment.update(s, str(root))
    assert (change.read, change.parsed) == (6, 6)
    nodes, edges = increment.settle(s)
    got = {(r.id, r.type) for r in nodes.collect()}
    assert {("paper.pdf", "doc"), ("paper.pdf::INTRODUCTION", "concept"), ("paper.pdf::RELATED WORK", "concept"), ("a.docx", "doc"), ("a.docx::One & all", "concept"), ("c.md::Ünïcode", "concept")} <= got
    assert not {i for i, _ in got if "scan" in i or "broken" in i or i == "b.docx::One & all"}
    assert {(r.src, r.dst) for r in edges.collect()} >= {("paper.pdf", "paper.pdf::RELATED WORK"), ("a.docx", "a.docx::One & all")}
    (root / "paper.pdf").write_bytes(made([long.replace(b"INTRODUCTION", b"FOREWORD")]))
    assert increment.update(s, str(root)).parsed == 1 and "paper.pdf::FOREWORD" in {r.id for r in increment.settle(s)[0].collect()}
    assert {r.path.rpartition("/")[2] for r in files.document_text(spark, str(root)).where("content is not null").collect()} >= {"paper.pdf", "a.docx"}


def test_commit_log_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=A | B", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert commits.commit_log(spark, str(tmp_path)).collect() == []
    git("init", "-q")
    assert commits.commit_log(spark, str(tmp_path)).collect() == []
    for i in range(21):
        (tmp_path / f"f{i % 4}.txt").write_text(str(i))
        (tmp_path / "ü x.txt").write_text(str(i // 5))
        git("add", "-A")
        git("commit", "-q", "-m", f"fix | {i}")
    read = lambda n, **o: sorted(map(tuple, commits.commit_log(spark, str(tmp_path), n, **o).collect()))
    one = read(1)
    assert len(one) == 21 + 5 and one == read(8) == read(100)
    assert {r[3] for r in one} == {f"fix | {i}" for i in range(21)} and {r[1] for r in one} == {"A | B"} and "ü x.txt" in {r[4] for r in one}
    assert {r[3] for r in read(3, commits=4)} == {f"fix | {i}" for i in range(17, 21)}
    assert commits.commit_log(spark, str(tmp_path), 8).rdd.getNumPartitions() == 7
