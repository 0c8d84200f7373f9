"""Every registered query against its SQL on the smallest tables, and those without SQL against stated rows."""

import math

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)[:10] if type(v).__name__ in ("date", "datetime") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert got == want


def rows(spark, name):
    return [tuple(r) for r in catalog.queries()[name](spark, SF).collect()]


def test_sections(spark):
    found = {(r[0], r[1]): r for r in rows(spark, "split_sections")}
    assert found[1, 1][2:4] == ("info_card", "Информационная карта")
    assert found[1, 1][5] == "РАЗДЕЛ № 1. Информационная карта\nпервая строка\nвторая"
    assert found[1, 2][3] == "Общие сведения"
    assert [k for k in found if k[0] == 2] and (3, 1) not in found
    missing = {r[0]: r[2:] for r in rows(spark, "required_minus_found")}
    assert missing[2] == ("", True) and missing[3][1] is False
    assert missing[1] == ("tz,contract,forms,nmcd", False)


def test_hints(spark):
    found = {r[0]: r[1:] for r in rows(spark, "extract_hints")}
    assert found[1] == ("Адрес: г. Москва, ул. Ленина, д. 5", "")
    assert found[3] == ("", "Собственник: ФГУП «Вода»")
    assert found[4] == ("", "")


def test_charsets(spark):
    assert {r[1] for r in rows(spark, "decode_bytes")} == {"Положение о закупке товаров, работ и услуг"}
    assert [r[1] for r in sorted(rows(spark, "mojibake_fix"))][1:] == ["Положение о закупке"] * 2
    assert rows(spark, "homoglyph_fix") == [(1, "Срок подачи заявок a@mail.ru COM")]
    assert dict(rows(spark, "text_similarity_ratio"))[1] == 0.857143


def test_chunks_follow_paragraphs(spark):
    from tessera.operators.chunking import chunk

    head = "а" * 700
    text = head + "\n\n" + "б" * 900
    d = spark.createDataFrame([(1, 1, text), (1, 2, "   "), (2, 1, head + "\n1. " + "в" * 900), (3, 1, None)], "file_id int, page int, text string")
    got = sorted(map(tuple, chunk(d).collect()))
    assert [(r[0], r[1], r[3], len(r[4])) for r in got] == [(1, 0, 0, 700), (1, 1, 1000, 602), (2, 0, 0, 700), (2, 1, 1000, 604)]


def test_files(spark, tmp_path):
    import zipfile

    from tessera.sources import files

    (tmp_path / "a.txt").write_bytes("Срок подачи\fдва".encode("cp1251"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = sorted((r.filename, r.page, r.text, r.error) for r in files.load(spark, str(tmp_path)).collect())
    assert got == [
        ("a.txt", 1, "Срок подачи", None), ("a.txt", 2, "два", None), ("b.pdf", 0, "", "no reader for pdf"), ("d.docx", 1, "one\nx | y", None),
    ]


def test_collections(spark, tmp_path):
    from tessera.sources import collections as c

    path = str(tmp_path / "kb")
    c.append(spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f2", " ")], "file_id string, text string"), path, "law")
    c.append(spark.createDataFrame([("f1", "c")], "file_id string, text string"), path, "law")
    assert sorted(r.text for r in c.read(spark, path, "law").collect()) == ["b", "c"]
    assert c.remove(spark, path, "law", "f2") and not c.remove(spark, path, "law", "f9")
    assert [r.file_id for r in c.files(spark, path, "law").collect()] == ["f1"]


def test_entry_without_the_training_data_operators(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def refuse(name, g=None, l=None, fromlist=(), level=0):  # noqa: E741
        if name.startswith(("tessera.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, g, l, fromlist, level)

    entry = importlib.import_module("__spark_entry__")
    # Where the folders are absent nothing of them is looked for, and the rest imports none of it.
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    monkeypatch.setattr(builtins, "__import__", refuse)
    assert "chunk_text" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
