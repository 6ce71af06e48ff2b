import pytest

from pageframe.llm import exemplars
from pageframe.llm.residue import ResidueIndex, find_residue, terms

BODY = "The court accepts that the claim was settled. The witness [sic] recalled [2013] UCA 4 and A.________ for [REDACTED] and […]. "


@pytest.fixture(scope="module")
def index():
    return ResidueIndex({"the": 5000, "not": 40, "found": 900, "page": 50, "to": 900, "this": 90, "is": 900}, 100_000)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (BODY + "{{party_name}} agreed.", "field"), (BODY + "on [INSERT DATE].", "field"), (BODY + "paid undefined to", "field"), (BODY + "on XX/XX/20XX", "field"), (BODY + "<NAME>", "field"), (BODY + "[à compléter]", "field"),
        (BODY + "\nLorem ipsum dolor sit amet.\n", "filler"), (BODY + "\nasdf asdf asdf asdf\n", "filler"),
        ("Error 404 - Page not found\nBack to results", "error"), ("<html><head><title>403 Forbidden</title></head><body><p>Powered by docket-view</p></body></html>", "error"),
        ('{"status": 404, "error": "You have been signed out. Log in again to read the document.", "trace": "0117d2e6a788"}', "notice"),
        ("Please enable JavaScript in your browser to view this decision.\nHome | Search | Help | Contact", "notice"),
    ],
)
def test_residue(index, text, kind):
    assert index.judge(text)[0] == kind


@pytest.mark.parametrize(
    "text",
    [None, "", " \n", BODY, BODY + 'The claimant saw only the message "404 Not Found" when the site was moved.', BODY + "visitors had to enable JavaScript and to accept cookies before an order", BODY + "<|endoftext|> <s></s><unk> {a; b} := ~ ___ ***", "中文 текст 🙂"],
)
def test_no_residue(index, text):
    assert index.judge(text) is None


def test_table(texts):
    rows = [(1, BODY * 50), (2, "Access denied\nBack to results"), (2, "Access denied\nBack to results"), (3, None), (4, ""), (5, BODY * 2000 + "%DECISION_DATE%")]
    got = sorted((r["id"], r["kind"]) for r in find_residue(texts(rows), "id", "text").collect())
    assert got == [(2, "error"), (5, "field")]
    assert find_residue(texts([]), "id", "text").count() == 0


def test_fields_by_containment():
    index = ResidueIndex({"the": 50_000, "of": 40_000, "to": 30_000, "be": 9000, "date": 900, "name": 300, "hearing": 800, "respondent": 900, "claimant": 900, "court": 5000, "insert": 5, "added": 90}, 1_000_000)
    for span in ("[insert date of hearing]", "[name of the respondent]", "{court_name}", "{name}", "[date of judgment to be inserted]", "[INSERT DATE]", "[TITLE]", "[bitte ergänzen]"):
        assert index.judge(f"The court heard {span} and dismissed the claim.") == ("field", span)
    for span in ("[name withheld]", "[REDACTED]", "[sic]", "[emphasis added]", "[Respondent]", "[the court]", "{a; b}", "[...]", "[the date and the name of a witness who was heard]"):
        assert index.judge(f"The court heard {span} and dismissed the claim.") is None


def test_wrapped_and_partial(index):
    assert index.judge("Please enable JavaScript in your browser\nto view this decision.")[0] == "notice"
    assert index.judge("Bitte aktivieren Sie JavaScript,\num das Urteil\nanzuzeigen.\nHome | Search | Help | Contact")[0] == "notice"
    for text in ("Lorem ipsum dolor sit amet.", "Lorem ipsum dolor sit amet consectetur adipiscing", "Replace this\ntext with\nyour own."):
        assert index.judge(BODY + "\n" + text + "\n" + BODY)[0] == "filler"
    assert index.judge("The court heard the clerk say: please enable JavaScript\nin your browser to view this decision, and dismissed the claim.") is None


# Wordings that no exemplar has, by kind.
HELD_OUT = {
    "page": (
        "The page you are looking for was not found", "You don't have permission to access this document", "Your session expired. Please log in again.", "This server is under maintenance", "The requested document is not available",
        "Something went wrong while processing your request", "Too many requests. Please try again in 30 minutes.", "503 The service is unavailable", "Error 500: internal server error", "Access to this page was denied",
        "JavaScript must be enabled in your browser", "Please turn on JavaScript and reload this page", "You must accept our cookies before the page can be shown", "Please confirm you are not a robot", "You were logged out. Log in again to continue.",
        "Die Seite wurde nicht gefunden", "Bitte aktivieren Sie JavaScript", "Ihre Sitzung ist leider abgelaufen", "La page est introuvable", "Veuillez activer JavaScript pour voir cette page", "Service temporairement indisponible",
        "La página no fue encontrada", "Debe activar JavaScript para ver la página", "La pagina non è stata trovata", "Attivare JavaScript per vedere la pagina", "Pagina căutată nu a fost găsită", "Activați JavaScript pentru a vedea pagina",
    ),
    "filler": (
        "Your heading goes here", "Sample content", "This is a dummy text", "Replace this text", "asdf asdf asdf", "blah blah blah blah", "Placeholder text", "Insert your text here", "Subtitle goes here", "Dies ist ein Blindtext", "Mustertext Mustertext",
        "Texte de remplissage ici", "Texto de relleno aquí", "Testo segnaposto qui", "Text provizoriu aici", "Lorem ipsum dolor sit amet, sed do eiusmod", "Duis aute irure dolor in voluptate", "Sample text only",
    ),
    "field": (
        "{{ customer.name }}", "{{respondent}}", "{% for party in parties %}", "<%= decision.date %>", "${filing_date}", "{3}", "{JUDGE}", "{party.name}", "[[Applicant]]", "«Court_Name»", "<<JUDGE>>", "@@DATE@@", "%COURT%", "#FILE_NO#", "$COURT$", "__DATE__",
        "[insert amount]", "[to be completed]", "[date to be confirmed]", "[NAME]", "[Name of the judge]", "[einfügen]", "[à compléter]", "[por completar]", "[da completare]", "[de completat]", "<ADDRESS>", "undefined", "[object Object]", "NaN", "%d", "DD/MM/YYYY", "XX.XX.XXXX", "0000-00-00",
    ),
}


def test_held_out_wordings(texts):
    """Nine of ten wordings that no exemplar has are found in a corpus, and what only looks like them is not."""
    usual = (
        "The bench of the court has heard the parties about the fee for this file, and it was not in the record that the service is to be shown on this page, as they have said to us.",
        "Das Gericht hat die Parteien gehört und die Seite der Akten, um die Forderung, die nicht bezahlt wurde, ist für sie zu prüfen.", "La cour a entendu les parties sur la demande, qui est pour cette page dans le dossier, et ne la voit pas.",
        "El juzgado ha oído a las partes para ver la demanda, que no fue pagada en el plazo y no la debe.", "La corte ha sentito le parti per la domanda, che non è stata pagata nel termine e la somma.", "Instanța a ascultat părțile pentru a vedea cererea, care nu a fost plătită și la dosar.",
    )
    decisions = [BODY + f"{k}. " + usual[k % 2 and k // 2 % 5 + 1] for k in range(3000)]
    spoken = [
        BODY + 'The portal showed "404 Not Found" to the claimant.', BODY + "The parties agree that JavaScript was not enabled in the browser of the witness.", BODY + "The dummy text in the contract was the reason for the claim about it.",
        BODY + "[name withheld]", BODY + "[2013] UCA 4", BODY + "[...] (sic)", "<|endoftext|> <s></s><unk> {a; b} := ~ ___ ***", BODY + "<p>The claim</p>", BODY + "It was 100 % paid and $ 5 due.", "中文 текст", BODY + 'The field was "undefined" at law.',
    ]
    cases = [(x, k) for k, xs in HELD_OUT.items() for x in xs]
    rows = list(enumerate(decisions + spoken)) + [(10_000 + n, x if k == "page" else f"{BODY}\n{x}\n{BODY}" if k == "filler" else f"{BODY} It was {x} then.") for n, (x, k) in enumerate(cases)]
    found = {r["id"]: r["kind"] for r in find_residue(texts(rows), "id", "text").collect()}
    assert not [i for i in found if i < 10_000]
    for kind, wordings in HELD_OUT.items():
        kinds = ("error", "notice") if kind == "page" else (kind,)
        got = [x for n, (x, k) in enumerate(cases) if k == kind and found.get(10_000 + n) in kinds]
        assert len(got) >= 0.9 * len(wordings), sorted(set(wordings) - set(got))
    # no wording is an exemplar
    known = {" ".join(terms(x)) for kind in exemplars.by_kind().values() for x in kind}
    assert not [x for k in ("page", "filler") for x in HELD_OUT[k] if " ".join(terms(x)) in known - {"placeholder text"}]


def test_pseudo_latin_is_learnt(texts):
    """Words that stand with the first words of pseudo-Latin in the corpus are filler without those too; a decision's words are not."""
    latin = ["lorem ipsum varde culpan oriste sutra", "Lorem ipsum culpan farro sutra varde oriste.", "lorem ipsum farro varde culpan"]
    rows = [(k, BODY + f"Number {k}.") for k in range(200)] + [(1000 + k, BODY + "\n" + x) for k, x in enumerate(latin)] + [(2000, BODY + "\nSutra varde oriste farro.\n"), (2001, BODY + "\nThe lorem ipsum of the court claim.")]
    found = {r["id"]: r["kind"] for r in find_residue(texts(rows), "id", "text").collect()}
    assert {1000, 1001, 1002, 2000} <= found.keys() and set(found.values()) == {"filler"} and not [i for i in found if i < 1000]
