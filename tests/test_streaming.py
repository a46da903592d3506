import os
import tempfile

from litsieve.functions.lexicon import Lexicon
from litsieve.streaming import screen


def test_stream_tags_like_batch(spark):
    root = tempfile.mkdtemp(prefix="litsieve-stream-")
    land = os.path.join(root, "landed")
    rows = [(1, "the cat", None, "2001", None, "s"), (2, "le chien", "de la", "2002", "10.1/x", "s"),
            (3, "nothing", None, None, None, "s")]
    from litsieve.schema import PAPER_SCHEMA
    spark.createDataFrame(rows, PAPER_SCHEMA).write.parquet(land)
    core = Lexicon.from_text("alpha: the\nbeta: le, de\n")
    stream = screen.read_paper_stream(spark, land)
    q = screen.start_screening(screen.tag_stream(stream, core), os.path.join(root, "out"),
                               os.path.join(root, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    got = {r["paper_id"]: r["primary_category"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    assert got == {1: "alpha", 2: "beta", 3: "Uncategorized"}
