import uuid

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, size string, doc string, _row string"
WORDS = "Los días claros traen viento suave y la gente camina despacio por la orilla del río mientras cae la tarde sobre los tejados"


def extra(i, text, lang="es", source="a"):
    """A row with columns whose names the operators use themselves."""
    return (i, text, lang, source, len(text or ""), 7, "x", "y", "z", "w")


#: Nulls in any column, empty and very long texts, ties, repeated rows.
EDGE = [
    extra(1, WORDS + ".\n" + WORDS + " otra vez."), extra(2, WORDS + ".\nAlgo distinto que no está en otro sitio."), extra(2, WORDS + ".\nAlgo distinto que no está en otro sitio."), extra(3, ""), extra(4, None), extra(None, "un texto sin número"), extra(5, "  \t\n "),
    extra(6, "x" * 30_000), extra(7, "palabra " * 20_000), extra(8, "Solo uno", None, None), extra(9, "ÉÉ é ﬁn   Ạ̀ 한국 ｆｕｌｌ", "fr", "b"), extra(10, "éé é fin Ạ̀ 한국 full", "fr", "b"), extra(11, "<|endoftext|> uno  <|endoftext|>dos \n tres   cuatro\x1c cinco seis", "en", "z"), extra(12, WORDS.upper() + "!!! *** ###", "es", "a"),
]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes rows as documents.parquet (and others) and returns the folder."""

    def make(rows, labels=(), pages=()):
        at = tmp_path_factory.mktemp("sf") / uuid.uuid4().hex
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string, row long").write.parquet(f"{at}/pages.parquet")
        return str(at)

    return make


@pytest.fixture(scope="session")
def edge(folder):
    return folder(EDGE, [(1, 1, 0), (2, 1, 0), (2, None, 0), (None, 1, 0), (7, 0, 0), (10, 1, 1)], [(1, "http://a/\r\nb", "<p>" + "ñ" * 9000 + "</p>", 1), (2, None, None, 1), (3, "u", "corto", 1), (4, "u", "corto", 1), (None, "u", "z" * 200, 1), (6, "u", "z" * 200, 1), (6, "u", "z" * 200, 1), (7, "u", "", None)])


@pytest.fixture(scope="session")
def empty(folder):
    return folder([])
