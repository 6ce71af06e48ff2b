"""Labelled exemplars of residue, by kind: usual wordings, in the six languages of the corpus.

They are what a reader would recognise, not what a table holds: the tests keep
other wordings of each kind apart, which the index has to find by them. Digits
stand for any number.
"""

from __future__ import annotations

from http import HTTPStatus

# Wordings of error pages. The reason phrases of HTTP are added by rule.
ERRORS = (
    "Error 1 - page not found", "The page you requested does not exist", "The document you asked for is not available on this server", "The requested resource is unavailable", "Access denied", "Access to this resource is denied", "You do not have permission to view this page",
    "Your request was blocked", "Your session has expired", "Session expired", "Site under maintenance", "Under maintenance", "We are carrying out maintenance", "The server is temporarily offline", "The service is unavailable, please try again later", "Try again in 1 minutes",
    "Just a moment", "Checking your browser", "Oops! Something went wrong", "An unexpected error occurred", "Your request could not be processed", "The request could not be completed", "Too many requests from your address",
    "Database connection failed", "Error establishing a database connection", "Fatal error on line 1", "Error reference 1", "Incident number 1",
    "Seite nicht gefunden", "Zugriff verweigert", "Interner Serverfehler", "Dienst nicht verfügbar", "Ihre Sitzung ist abgelaufen", "Wegen Wartungsarbeiten nicht erreichbar",
    "Page introuvable", "Page non trouvée", "Accès refusé", "Erreur interne du serveur", "Service indisponible", "Votre session a expiré", "Site en maintenance",
    "Página no encontrada", "Acceso denegado", "Error interno del servidor", "Servicio no disponible", "Su sesión ha caducado", "Sitio en mantenimiento",
    "Pagina non trovata", "Accesso negato", "Errore interno del server", "Servizio non disponibile", "La sessione è scaduta", "Sito in manutenzione",
    "Pagina nu a fost găsită", "Acces interzis", "Eroare internă de server", "Serviciu indisponibil", "Sesiunea a expirat", "Site în mentenanță",
)
# Notices that something is required before the text can be shown.
NOTICES = (
    "Please enable JavaScript to view this page", "JavaScript is required in your browser", "Turn on scripts and reload the page", "This site needs scripts to work", "You must accept cookies to continue", "Cookies are needed before the content can be shown",
    "Please log in again to read the document", "You have been signed out", "You have been logged out", "Confirm that you are human", "Prove you are not a robot to continue", "Check the address or use the search form", "Return to the home page",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser", "JavaScript ist nötig, um diese Seite anzuzeigen", "Bitte akzeptieren Sie Cookies", "Bitte melden Sie sich erneut an",
    "Veuillez activer JavaScript dans votre navigateur", "JavaScript est nécessaire pour afficher cette page", "Veuillez accepter les cookies", "Veuillez vous reconnecter",
    "Debe activar JavaScript en su navegador", "Active los scripts para ver esta página", "Debe aceptar las cookies", "Inicie sesión de nuevo",
    "Attivare JavaScript nel browser", "JavaScript è necessario per visualizzare la pagina", "Accettare i cookie", "Effettuare di nuovo l'accesso",
    "Activați JavaScript în browser", "JavaScript este necesar pentru a vedea pagina", "Acceptați cookie-urile", "Autentificați-vă din nou",
)
# The core of most notices, in each language: what must be turned on or accepted.
NEEDS = (
    "enable JavaScript", "turn on scripts", "accept cookies", "JavaScript aktivieren", "Skripte aktivieren", "Cookies akzeptieren", "activer JavaScript", "activer les scripts", "accepter les cookies",
    "activar JavaScript", "activar los scripts", "aceptar las cookies", "attivare JavaScript", "attivare gli script", "accettare i cookie", "activați JavaScript", "activați scripturile", "acceptați cookie-urile",
)
# What stands on such pages beside: what the reader could do then, and links.
FURNITURE = (
    "to view this page", "to see the content", "to read the document", "um die Seite anzuzeigen", "um den Inhalt zu sehen", "pour afficher la page", "pour voir le contenu",
    "para ver la página", "para ver el contenido", "per visualizzare la pagina", "per vedere il contenuto", "pentru a vedea pagina", "pentru a vedea conținutul",
    "Home | Search | Help | Contact", "Back to results", "Back to the home page", "Powered by", "© Portal", "Court portal", "All rights reserved", "Privacy policy", "Terms of use", "Sitemap",
    "Startseite | Suche | Hilfe | Kontakt", "Accueil | Recherche | Aide | Contact", "Inicio | Buscar | Ayuda | Contacto", "Pagina iniziale | Cerca | Aiuto | Contatti", "Acasă | Căutare | Ajutor | Contact",
)
#: Words of a clause of pseudo-Latin.
CLAUSE = 4
# Text that stands in for content. The first is the usual pseudo-Latin;
# what else stands in its passages is learnt from the corpus.
PSEUDO_LATIN = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
)
FILLER = (
    "asdf", "asdf asdf", "qwerty", "jkl jkl jkl", "blah blah blah", "foo bar baz", "xxx xxx xxx", "test test test", "text text text",
    "Your text here", "Your title here", "Insert text here", "Title goes here", "Heading goes here", "Content goes here", "Sample text", "Example text", "Dummy text", "Dummy content", "This is placeholder text", "For layout purposes only",
    "Replace this text with your own", "This paragraph will be replaced", "To be replaced", "Please replace this", "Type here", "Content coming soon",
    "Mustertext", "Blindtext", "Platzhaltertext", "Dies ist ein Platzhalter", "Hier steht Ihr Text", "Dieser Text wird noch ersetzt", "Beispieltext",
    "Texte de remplissage", "Texte à remplacer", "Votre texte ici", "Faux texte", "Texto de relleno", "Su texto aquí", "Texto por sustituir", "Texto de ejemplo",
    "Testo segnaposto", "Il tuo testo qui", "Testo da sostituire", "Testo di esempio", "Text provizoriu", "Textul dumneavoastră aici", "Text de înlocuit", "Text de umplutură",
)
# Words that ask for a field to be filled.
ASKS = (
    "insert", "enter", "fill in", "complete", "to be completed", "to be inserted", "to be added", "to be confirmed", "tbd", "tba", "tbc", "todo", "your name here", "pending",
    "bitte ergänzen", "bitte einsetzen", "einfügen", "ausfüllen", "à compléter", "à insérer", "à remplir", "por completar", "completar", "rellenar", "insertar", "da completare", "inserire", "compilare", "de completat", "completați", "inserați",
)
# What a field is called after.
NAMES = (
    "title", "name", "date", "address", "amount", "number", "reference", "signature", "place", "city", "court name", "party name", "case number", "file number", "full name", "street", "currency", "phone", "email",
    "name of the claimant", "name of the respondent", "name of the defendant", "name of the applicant", "name of the appellant", "name of the judge", "name of the court", "name of the party",
    "date of the hearing", "date of the decision", "date of the judgment", "date of birth", "address of the claimant", "address of the respondent",
    "name des klägers", "datum der verhandlung", "nom du demandeur", "date de l'audience", "nombre del demandante", "fecha de la vista", "nome del ricorrente", "data dell'udienza", "numele reclamantului", "data ședinței",
)
# One field in the marks of each template language.
TEMPLATES = ("{{ name }}", "{% if date %}", "<%= title %>", "${amount}", "{0}", "{NAME}", "{case.name}", "[[Name]]", "«Name_A»", "<<NAME>>", "@@NAME@@", "%NAME%", "#NAME#", "$NAME$", "__NAME__")
# What programs write for a missing value, and dates that are none.
VALUES = ("undefined", "[object Object]", "NaN", "(null)", "%s", "%d", "xx/xx/xxxx", "xx/xx/20xx", "dd/mm/yyyy", "mm/dd/yyyy", "yyyy/mm/dd", "tt/mm/jjjj", "jj/mm/aaaa", "dd/mm/aaaa", "gg/mm/aaaa", "zz/ll/aaaa", "00/00/0000", "0000/00/00")


def by_kind() -> dict[str, tuple[str, ...]]:
    """The exemplars of passages; those of fields are held against marked spans only."""
    reasons = tuple(f"1 {s.phrase}" for s in HTTPStatus if s >= 400 and s != 418)  # 418 is a joke
    # pseudo-Latin begins and ends anywhere, so every few words of it are an exemplar
    latin = [x.split() for x in PSEUDO_LATIN]
    clauses = tuple(" ".join(x[k : k + CLAUSE]) for x in latin for k in range(len(x) - CLAUSE + 1))
    return {"error": (*ERRORS, *reasons), "notice": (*NOTICES, *NEEDS), "furniture": FURNITURE, "filler": (*clauses, *FILLER)}
