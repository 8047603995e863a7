"""The request sink passes whole texts on; snk_01's SQL measures their first 500 characters."""

from dossier.plans import ingesting, registry
from tests.sql_twin import DATA


def test_whole_texts(spark, monkeypatch):
    seen, requests = [], ingesting.L.requests
    monkeypatch.setattr(ingesting.L, "requests", lambda *a: seen.append(requests(*a)) or seen[0])
    registry.queries()["snk_01_requests"](spark, DATA)
    sent = {r["i"]: r["t"] for r in seen[0].selectExpr("get_json_object(value, '$.recordId') AS i", "get_json_object(value, '$.modelInput.messages[0].content[0].text') AS t").collect()}
    texts = {f"doc-{r['doc_id']}": r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sent == texts and max(map(len, texts.values())) > 500
