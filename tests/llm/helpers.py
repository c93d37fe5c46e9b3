from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    """Documents with these texts and ids from 0; extra: columns that may have any name."""
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return with_extra(spark.createDataFrame(rows, DOCS), extra)


def with_extra(df, extra):
    from pyspark.sql import functions as F

    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Names that operators use inside, as columns of their input.
CLASHES = {k: 1 for k in ("id", "doc", "row", "node", "label", "first", "n", "fp", "key", "item", "sh", "bucket", "version", "spans", "is_lang", "held_out", "score", "shard", "size", "kept", "bad", "pos", "letters", "known", "version", "row", "a.b", "c0", "c3")}

WORDS = "amber basin cedar delta ember fable grove haven inlet jetty kiosk lemon maple noble ocean pearl quilt river stone tulip".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def broadcast_rows(spark, run) -> list[int]:
    """Rows of each table that Spark broadcast in the queries of run(), the most first."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    before, rows = executions(), []
    run()
    for id_ in executions() - before:
        values, nodes = store.executionMetrics(id_), store.planGraph(id_).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                ids = [node.metrics().apply(i).accumulatorId() for i in range(node.metrics().size()) if node.metrics().apply(i).name() == "number of output rows"]
                rows += [int(values.get(i).get().replace(",", "")) for i in ids if values.get(i).isDefined()]
    return sorted(rows, reverse=True)
