"""Operators that write files of their own, in a session whose tasks die once and run again."""

import os
import subprocess
import sys
import textwrap


def test_tasks_that_die_once_change_no_result(tmp_path):
    """Each task over the input yields half of its rows and dies, the first time; results are those of a run without deaths."""
    script = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession, functions as F
        from acreframe.llm import collocations, exact_dedup, repeats, warc

        spark = (SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
            .config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").getOrCreate())
        spark.sparkContext.setLogLevel("OFF")
        words = F.array(*map(F.lit, ["so", "it", "goes", "on", "and", "up"]))
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.element_at(words, ((F.col("id") % 7 * k * k + k) % 6 + 1).cast("int"))), " ")
        rows = spark.range(0, 120, 1, 3).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("html"))
        rows.write.parquet("{tmp_path}/in")
        rows = spark.read.parquet("{tmp_path}/in").repartition(3, "doc_id")
        died = 0

        def dying(name):
            def run(batches):
                from pyspark import TaskContext
                context = TaskContext.get()
                mark = f"{tmp_path}/{{name}}-{{context.stageId()}}-{{context.partitionId()}}"
                for batch in batches:
                    yield batch.slice(0, batch.num_rows // 2)
                    if not os.path.exists(mark):
                        open(mark, "w").close()
                        raise ValueError("lost")
                    yield batch.slice(batch.num_rows // 2)
            return rows.mapInArrow(run, rows.schema)

        operators = {{
            "warc": lambda r: warc.round_trip(r.select("page_id", "url", "html")),
            "exact": lambda r: exact_dedup.groups(r.select("doc_id", "text")),
            "repeats": lambda r: repeats.digests(r, window=8, first=4),
            "phrases": lambda r: collocations.mined(r, least=4),
        }}
        for name, f in operators.items():
            want, got = sorted(map(str, f(rows).collect())), sorted(map(str, f(dying(name)).collect()))
            marks = sum(x.startswith(name + "-") for x in os.listdir("{tmp_path}"))
            print("SAME" if want == got else "DIFFERENT", name, len(want), marks, flush=True)
    """)
    told = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, env=os.environ)
    lines = [x.split() for x in told.stdout.splitlines() if x.startswith(("SAME", "DIFFERENT"))]
    assert [x[:2] for x in lines] == [["SAME", n] for n in ("warc", "exact", "repeats", "phrases")], told.stdout + told.stderr[-3000:]
    assert all(int(n) > 0 and int(marks) >= 2 for _, _, n, marks in lines)
