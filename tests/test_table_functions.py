"""Table functions in SQL."""

import random
import zipfile

from siftlark.functions import table_functions
from siftlark.operators import parser


def random_texts(n):
    draw = random.Random(2)
    pieces = ["\nInclusion Criteria:\n", "\nexclusion criteria\n", "\nExclusion Criteria\n", "age 18-65 years", "age 70 to 20 years", "at least 18 years", "Age at most 9 years", "age >= 21", "age ≤ 80", " unless ill", " (adults)", "\n", ", ", "age of ٣٠ years or older", "age 18 years and older", "text ", "é"]
    return [(i, "".join(draw.choices(pieces, k=draw.randint(0, 14)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_texts_of_a_table_and_lateral(spark):
    table_functions.register(spark)
    texts = spark.createDataFrame(random_texts(250), "doc_id long, eligibility_text string")
    texts.createOrReplaceTempView("trial_texts")
    key = lambda r: (str(r.doc_id), r.category, r.source_text, r.source_start, r.source_end, r.operator, r.years, tuple(r.review_reasons), float(r.parser_confidence))
    wanted = sorted(key(r) for r in parser.parse_criteria(texts).collect())
    lateral = spark.sql("SELECT t.doc_id, c.* FROM trial_texts t, LATERAL parse_eligibility(t.eligibility_text) c")
    whole = spark.sql("SELECT * FROM parse_eligibility_of(TABLE(SELECT doc_id, eligibility_text FROM trial_texts))")
    assert len(wanted) > 100 and sorted(map(key, lateral.collect())) == wanted and sorted(map(key, whole.collect())) == wanted


def test_members_of_archives(spark, tmp_path):
    table_functions.register(spark)
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w") as out:
            for m in range(k * 120):
                out.writestr(f"d/{m}.xml", f"<x>é{k}.{m}</x>")
            out.writestr("readme.txt", "no")
    paths = spark.createDataFrame([((tmp_path / f"a{k}.zip").as_uri(),) for k in range(3)], "path string")
    paths.createOrReplaceTempView("archives")
    found = spark.sql("SELECT a.path, m.* FROM archives a, LATERAL zip_members(a.path, '.xml') m").collect()
    got = sorted((r.path[-6:], r.member_no, r.member, r.content) for r in found)
    assert got == sorted((f"a{k}.zip", m, f"d/{m}.xml", f"<x>é{k}.{m}</x>") for k in range(3) for m in range(k * 120))
    assert spark.sql(f"SELECT count(*) AS n FROM zip_members('{(tmp_path / 'a1.zip').as_uri()}', '')").first().n == 121
