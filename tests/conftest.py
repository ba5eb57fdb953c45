import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lectern.runtime import local_session

    s = local_session("tests", 8, 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


PAPER = (
    "paper_id long, library string, folder string, stem string, rel_path string, file_path string, size_bytes long, mtime timestamp, birthtime timestamp, title string, abstract string, "
    "authors array<string>, arxiv_id string, arxiv_cat string, pub_year int, pub_month int, pub_date_source string, intro_excerpt string, title_is_filename boolean, needs_review boolean, ckey string, cached_at timestamp"
)


@pytest.fixture(scope="session")
def make_papers(spark):
    names = [c.split()[0] for c in PAPER.split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PAPER)

    return make
