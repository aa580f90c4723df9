"""Recall and precision of the residue operator over cases and near misses with vocabulary of their own.

Names, sentences and contexts were written after the operator; each kind holds 300 texts or
more (sentences times contexts).  What the first run missed led to additions, so only the
figures of that run, which the README gives, are held out.
"""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnspan.llm import residue

NAMES = ["vessel", "berth_no", "consignee", "Abteilung", "numéro_quai", "fecha_salida", "顧客番号", "船名", "order.total", "item2", "run-title", "supervisorEmail"]
STRONG = ["{{%s}}", "{{ %s }}", "{{{%s}}}", "<<%s>>", "{%% %s %%}", "<%%= %s %%>", "@@%s@@", "${%s}", "#{%s}", "%%(%s)s", "[insert %s]", "[%s goes here]", "[%s to be confirmed]", "<enter %s>", "(insert %s)", "【请填写%s】"]
PROSE = ["The crane at %s was serviced before dawn.", "We handed the papers to %s and left the harbour.", "Liegeplatz: %s", "According to the captain, %s arrived first and nobody complained."]
UPPER_NAMES = ["VESSEL_NAME", "BERTH_DATE", "CARGO_COUNT", "PILOT_NAME", "TOTAL_AMOUNT"]
UPPER = ["__%s__", "##%s##", "#%s#", "%%%s%%", "<%s>", "[%s]", "$%s$"]
BLANKS = ["Pilot: ________", "Signed on ______ by ______.", "Arrival: TBD", "Price: TODO. We ship on Monday.", "Tonnage: .....", "Agent: [ ]", "Contact: N.N.", "The fee is TBC and the date is TBC."]

ERRORS = [
    "Sorry, the page you are looking for could not be found.", "This site can't be reached", "This site can’t be reached.", "Access to this page has been denied.", "Erreur 404", "Fehler 404: Seite nicht gefunden", "The requested URL was not found on this server.",
    "502 Bad Gateway", "Your session has timed out. Please log in again.", "You are not authorized to view this page.", "We are currently down for maintenance. Please check back soon.", "The connection was reset.", "The link you followed has expired.",
    "Something went wrong on our end. Please try again in a few minutes.", "The server is temporarily unable to process your request.", "HTTP Error 500", "This content is no longer available.", "The file you requested has been removed.",
    "Die gewünschte Seite konnte nicht gefunden werden.", "Der Server antwortet nicht. Bitte versuchen Sie es später erneut.", "Sie haben keine Berechtigung, diese Seite zu sehen.", "Zugriff verweigert.", "Dieser Inhalt ist nicht mehr verfügbar.", "Die Verbindung wurde unterbrochen.",
    "Désolé, cette page est introuvable.", "Vous n'avez pas accès à ce document.", "Le serveur ne répond pas. Veuillez réessayer dans quelques minutes.", "Votre session a expiré. Veuillez vous reconnecter.", "Le service est temporairement indisponible.",
    "Lo sentimos, no encontramos la página solicitada.", "No tiene permiso para acceder a este archivo.", "El servicio no está disponible en este momento.", "La sesión ha caducado. Vuelva a iniciar sesión.", "Se produjo un error interno del servidor.",
    "抱歉，您访问的页面不存在。", "服务器内部错误，请稍后再试。", "您没有权限访问此页面。", "连接超时，请刷新页面。", "申し訳ございません、お探しのページは見つかりませんでした。", "サーバーに接続できません。しばらくしてから再度お試しください。", "このページを表示する権限がありません。", "セッションの有効期限が切れました。再度ログインしてください。",
]
NOTICES = [
    "Please turn on JavaScript in your browser settings to use this site.", "You must have JavaScript enabled to view this page.", "This website requires JavaScript to work properly.", "JavaScript seems to be disabled in your browser.", "Your browser does not support scripts.",
    "Scripts are blocked. Allow them and reload the page.", "To continue, please enable scripts for this site.", "Without JavaScript this application will not work.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Diese Seite funktioniert nur mit aktiviertem JavaScript.",
    "Ohne JavaScript kann diese Seite nicht angezeigt werden.", "Vous devez activer JavaScript dans votre navigateur.", "Ce site nécessite JavaScript.", "Pour continuer, autorisez les scripts.", "Debe habilitar JavaScript para utilizar esta aplicación.", "Este sitio requiere JavaScript.",
    "请在浏览器设置中启用 JavaScript。", "您需要开启 JavaScript 才能继续访问。", "ブラウザの設定で JavaScript を有効にしてください。", "このサイトを利用するにはスクリプトを許可してください。",
]
FILLERS = [
    "Lorem ipsum", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Placeholder text goes here.", "Your headline here", "This is sample text. Replace it with your own content.", "Insert text here.", "Add a caption here.", "Dummy content.", "bla bla bla bla bla bla bla bla",
    "qwerty asdf zxcv qwerty asdf", "lorem lorem lorem lorem lorem lorem", "one two one two one two one two one two one two", "Hier folgt später Text.", "Platzhaltertext, bitte ersetzen.", "Ihr Text hier.", "Ajoutez votre texte ici.", "Texte factice.", "Contenu à venir.", "Inserte su texto aquí.",
    "Texto provisional.", "在此输入内容。", "占位内容，待补充。", "ここに説明を入力します。", "サンプルテキストです。", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi.", "Navira pontas velum curis mandor. Teris lavant solum pontas gerunt malis.",
]
AROUND = ["%s", "# Harbour\n\n%s", "Start | Ships | Crew | Help\n\n%s\n\n© Port Office", "<p>%s</p>", "\n  %s  \n", "Overview\n\n%s\n\nTerms · Privacy · Help", "<html><body><h1>%s</h1><hr></body></html>", "%s\nRequest ID: 7f3a90bb12"]

CONTENT = ["The crane at berth 4 was serviced before dawn and lifted 31 containers.", "Der Lotse kam um neun Uhr an Bord.", "Le pilote est monté à bord à neuf heures.", "El práctico subió a bordo a las nueve.", "领航员九点登船。", "水先人は九時に乗船しました。"]
MISSES = [
    "Write `{{ vessel }}` where the ship's name belongs; the renderer puts it in.", "```\nprint(f\"{vessel}: {berth_no}\")\n```\nThe snippet prints the list.", "The placeholder {vessel} is filled by the booking job at night.", "A template with ${berth} expands to the number of the berth.",
    "usage: dock --ship <SHIP> --berth <BERTH>", "berth_no: ${port.berth}\nship_name: \"{{ ship }}\"\nlimit: 4", "export BERTH=${PORT}", "logger.info(\"{} left\", vessel);", "See [[harbour-plan]] for the map.", "The crew calls the tug «Möwe», the barge «Lotte».",
    "The set {1, 2} has two elements, and $x$ is one of them.", "The tokens <unk> and <pad> are special tokens of the vocabulary.", "Names are masked as XXXX in the shared list.", "We removed every TBD from the schedule last week.", "The old page said \"404 Not Found\" until the mirror of berth 4 was rebuilt.",
    "From nine on the gateway answered 502 to every third request, and the pilots phoned instead.", "2025-02-01T08:00:00Z ERROR GET /berths -> HTTP 503 after 20 ms", "The screen showed \"please enable JavaScript\" because the kiosk's profile had scripts off.", "The new map needs JavaScript, the old one worked without; pilots on slow links should keep the printed chart.",
    "We test the layout with lorem ipsum, but the crew list itself is real.", "\"Sample text\" in the demo hides that long ship names overflow the card.", "- \"Access denied\" is now logged with the name of the pilot.", "- The 404 page for closed berths links to the map now.", "Die Meldung „Seite nicht gefunden“ kam nur bei alten Links.", "Le message « Page introuvable » venait d'un ancien lien.",
    "El aviso «active JavaScript» salía solo en la pantalla del muelle.", "“404 页面不存在”的提示只出现在旧链接上。", "「ページが見つかりません」という表示は公開前だけでした。", "ok", "LGTM", "+1", "no change", "see berth 4", "[dock]\nberth = 4\nship = \"Lotte\"", "{\"berth\": 4, \"ship\": \"Lotte\"}", "| berth | ship |\n|---|---|\n| 4 | Lotte |",
    "The function takes {name} and {date} as arguments in its format string.", "Put `TODO` where the price belongs.", "user: What does {{x}} mean in the template?\nassistant: The renderer replaces it.", "SELECT ship FROM berths WHERE no = %(berth)s;",
]


def slots() -> list[str]:
    said = [p % (d % n) for d, n, p in itertools.product(STRONG, NAMES, PROSE)]
    said += [p % (d % n) for d, n, p in itertools.product(UPPER, UPPER_NAMES, PROSE)]
    return said + [f"{c} {b}" if b[0] != "T" else f"{b}\n{c}" for b in BLANKS for c in ["", *CONTENT]]


KINDS = {
    "slots": slots(),
    "errors": [a % e for a in AROUND for e in ERRORS],
    "notices": [a % n for a in [*AROUND, *(f"{x}\nLoading…" for x in AROUND)] for n in NOTICES],
    "filler": [a % f for a in [*AROUND, "%s\n\n%%s" % "Port › Ships › Crew", "== Crew ==\n%s", "- %s", "%s\n%s"] for f in FILLERS for a in [a if a.count("%s") == 1 else a.replace("%s", "%s", 1).replace("\n%s", "")]],
}
NEAR = [m for m in MISSES] + [f"{c}\n\n{m}\n\n{c}" for m in MISSES for c in CONTENT] + [f"{c} {e}" for c in CONTENT for e in ERRORS[:10] + NOTICES[:5] + FILLERS[2:8]]


@pytest.mark.parametrize("kind", KINDS)
def test_recall(kind):
    texts = KINDS[kind]
    missed = [t for t in texts if not residue.is_residue(t)]
    print(kind, len(texts), round(1 - len(missed) / len(texts), 4), missed[:60])
    assert len(texts) >= 300
    assert len(missed) <= 0.05 * len(texts)


def test_precision():
    wrong = [t for t in NEAR if residue.is_residue(t)]
    found = sum(residue.is_residue(t) for texts in KINDS.values() for t in texts)
    print(len(NEAR), len(wrong), round(found / (found + len(wrong)), 4), wrong[:60])
    assert len(NEAR) >= 300
    assert len(wrong) <= 0.02 * len(NEAR)


@pytest.mark.parametrize("pieces", [1, 40, 4000])
def test_verdict_does_not_hang_on_length(pieces):
    """The same case, near the start or the end of a short or a long text."""
    body = "The crane was serviced before dawn and the crew went home. " * pieces
    for slot in ("Owner: TODO. The ship left.", "We handed it to {{ pilot.name }} at noon."):
        assert residue.is_residue(body + slot) and residue.is_residue(slot + " " + body)
    assert not residue.is_residue(body + "404 Not Found") or pieces == 0
    menu = " | ".join(["Ships", "Crew", "Map"] * pieces)
    assert residue.is_residue(menu + "\n\n404 Not Found\n\nThe page does not exist.")


def test_stray_example_of_a_tutorial():
    told = "Write `{{ ship }}` in the template; the renderer fills it in. " * 30
    assert not residue.is_residue(told + "\nThen the letter begins with {{ship}} as usual.")
    assert residue.is_residue("Dear {{ship}}, your berth is {{berth}}. " * 3 + told)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"{}[]<>«»%$@_#()【】（）. :\nAb1", "...", "name", "TBD", "TODO", "XX", "N.N.", "T.B.D.", "insert ", " here", "填写", "……", "____", "{{", "}}", "Owner: "]), max_size=25).map("".join))
def test_hints_lose_no_slot(text):
    """Looking only where a hint stands finds what the grammars find anywhere."""
    assert [m.span() for m in residue.slot_hits(text)] == [m.span() for m in residue._SLOTS.finditer(text)]
