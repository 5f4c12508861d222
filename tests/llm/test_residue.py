import pytest
from pyspark.sql import functions as F

from quillgraph.llm import residue

CASES = ["Hello {{name}}, your order was closed.", "Dear [insert name here], thanks", "The %(title)s service is owned by us.", "Contact __OWNER_NAME__ first.", "Lorem ipsum dolor sit amet.", "404 Not Found", "Error 503: Something went wrong.", "<h1>500 Internal Server Error</h1>", '{"status": 410, "error": "Gone"}', "HTTP 503\nGET /x\nrequest id 12ab", "Please enable JavaScript to view this page.", "Bitte JavaScript aktivieren, um diese Seite anzuzeigen.", "Veuillez activer JavaScript pour afficher cette page.", "Active JavaScript para ver esta página.", "Description goes here. Description goes here.", "asdf asdf qwer test test", "Menta upsit cardo vexa avelo mirat parum menta ferra.", "Some real text about the parser.\n\nThe ${ownerName} service runs in {region}.", "blah blah blah, more words to come.", "La page demandée est introuvable."]
NO_CASES = ["The handler returns 403 if the token has expired.", 'We saw 27 responses with "502 Bad Gateway" during the deploy.', "Put `{{name}}` in the template.", "Example:\n\n```\nname: {{ version }}\n```\n\nThe value is taken from the job.", 'The crawler detects the notice "Please enable JavaScript" and renders such pages.', 'Removed the last "TODO: add description" lines.', "ok", "+1", "", None, "# Lever catalog tally\n\nThe parser keeps going after a bad girder.", "> 404 Not Found\n\nthat is what it said"]


def run(spark, texts):
    rows = [(i, t, "w", f"repo-{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, workspace_id string, repo string").withColumn("host", F.lit(1)).withColumn("kind", F.lit("x"))
    return {x["doc_id"] for x in residue.residue(df).collect()}


def test_cases(spark):
    assert run(spark, CASES) == set(range(len(CASES)))


def test_no_cases(spark):
    assert run(spark, NO_CASES) == set()


@pytest.mark.parametrize("text", ["x " * 300_000 + "\n\n{{name}}", "a" * 200_000])
def test_long(spark, text):
    assert run(spark, [text]) == ({0} if "{{" in text else set())


def test_evidence_adds_up(spark):
    told = "The old page said that something went wrong whenever " + "the reader of the ledger was told about it " * 12
    rows = [(i, told, "w", repo) for i, repo in enumerate(["same", "same"])]
    schema = "doc_id bigint, text string, workspace_id string, repo string"
    # a phrase in long prose from one host isn't enough, the same response from several is
    assert residue.residue(spark.createDataFrame(rows, schema)).count() == 0
    rows += [(2, told, "w", "other")]
    assert residue.residue(spark.createDataFrame(rows, schema)).count() == 3


def test_nulls_and_empty(spark):
    schema = "doc_id bigint, text string, workspace_id string, repo string"
    rows = [(1, "404 Not Found", None, None), (1, "404 Not Found", None, None), (None, "404 Not Found", "w", "r")]
    assert [x["doc_id"] for x in residue.residue(spark.createDataFrame(rows, schema)).collect()] == [1]
    assert residue.residue(spark.createDataFrame([], schema)).count() == 0


def test_responses_are_learned(spark):
    """No phrase of the detectors is in this sentence: it is known from the forms in which it stands."""
    said = "Der Betrachter von {} muss zuvor freigegeben werden."
    texts = [f"<noscript>{said.format('Alpha')}</noscript>", f"Error 503: {said.format('Beta')}", f"Gamma\n\n{said.format('Gamma')}\n\nHome | Docs | Status", said.format("Delta"), f'Die Seite meldete "{said.format("Eta")}" und wurde erneut geladen.']
    prose = "Wir haben {} Zeilen gelesen. " + "Der Abgleich von {} läuft jede Nacht. Danach folgt der Bericht über die Rollen."
    texts += [prose.format(i, "Zeta") for i in range(6)] + ["Error 500: Der Abgleich von Theta läuft jede Nacht."] * 2
    # what is seen in prose more often than in forms isn't learned, though the forms themselves are found
    assert run(spark, texts) == {0, 1, 2, 3, 11, 12}


def test_shape():
    assert residue.shape("Für Alpha müssen 3 Skripte") == "# müssen #" and residue.shape("") == ""
    assert residue.shape("Sign in at /a/b.") == residue.shape("Log in at /c.")


def test_numbered_filler(spark):
    assert run(spark, ["Part 1\nWords of part.\n".replace("Words of part", "Words of part 1") + "Part 2\nWords of part 2.", "Part 1\nWords of part 2\nIt took 3 of them\nand then 4."]) == {0}
