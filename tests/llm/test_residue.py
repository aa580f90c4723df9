"""Residue: cases and near misses."""

import pytest

from kilnspan.llm import residue

CASES = [
    "Dear {{customer_name}}, the run ended at iteration 5.",
    "Checkpoint: {{{checkpoint}}}\nDate: 2025-01-01",
    "Layer <<LAYER ID>> kept 12 experts busy.",
    "We restarted from [[checkpoint]] because of a fault.",
    "The loss fell to {% value %} on this run.",
    "Count: <%= count %>\nShare: 12%",
    "Rank @@RANK_ID@@ reported late.",
    "Only __COUNT__ rows were moved.",
    "It held %(dataset_name)s for a while.",
    "It was repeated %COUNT% times.",
    "Please rerun ${RUN_NAME} before noon.",
    "For <RUN NAME> the slope was flat, so we held.",
    "Value: [INSERT VALUE HERE]",
    "Only [fill in: duration] earlier we saw the same.",
    "In <your share> of the tokens it agrees.",
    "For ________ I would keep the weights.",
    "Owner: TBD\nDate: TBD",
    "占比升到 【请填写】。",
    "Layer {layer_id} stayed idle.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "# Summary\n\nThis is placeholder text. Your content here.",
    "test test test Sample text goes here.",
    "示例文本，请替换。 测试测试测试",
    "Dies ist ein Blindtext.",
    "Texte d'exemple à remplacer.",
    "Texto de relleno. Aquí va su contenido.",
    "Home | Runs | Docs\n\n404 Not Found\n\nThe page you asked for does not exist or was moved.\n\n© portal",
    "<html><head><title>403 Forbidden</title></head><body><center><h1>403 Forbidden</h1></center></body></html>",
    '{"error": {"code": 500, "message": "The server could not load the requested report. Please try again later."}}',
    '<?xml version="1.0"?><Error><Code>AccessDenied</Code><Message>You do not have permission to view this run.</Message></Error>',
    "Interner Serverfehler\n\nBitte versuchen Sie es später erneut.",
    "Page introuvable\nLa page demandée n'existe pas ou a été déplacée.",
    "服务暂时不可用，请稍后再试。",
    "ページが見つかりません\nお探しのページは移動または削除されました。",
    "Please enable JavaScript to view this dashboard.",
    "<noscript>To use the viewer, turn on scripts and reload.</noscript>\n<div id=\"root\"></div>",
    "Diese Anwendung benötigt JavaScript.",
    "Active JavaScript para ver esta página.",
    "このページを表示するには JavaScript を有効にしてください。",
    "We're sorry but the console doesn't work properly without JavaScript enabled. Please enable it to continue.",
]
NOT = [
    None, "", "  \n ", "ok", "no change",
    "Write `{{ run_name }}` where the title belongs; the renderer puts the run in its place.",
    "```\nprint(f\"{gid}: {{x}}\")\n```\nThe snippet prints the id.",
    "Is the set {{1, 2}, {3}} a partition of {1, 2, 3}? Yes.",
    "path: \"${env:SCRATCH}/elm\"\nvalue: \"{{ .Values.runId }}\"",
    "See [[kelp-plan]] and [[mix-elm-1]] for the background.",
    "usage: dump --run <RUN-ID> --out <DIRECTORY>\n\nThe first option names the run.",
    "Put the flag parsing into __main__ and keep __init__ empty.",
    "The alert text holds %(iteration)s and %(metric)s; the rule fills them.",
    "The codename «velvet» was picked by vote, «umber» came second.",
    "I removed the last TBD from the plan. The date is set.",
    "Host ids are masked as XXXX in the shared copy.",
    'The kiosk showed "please enable JavaScript" because its profile had scripts off. We turned them on.',
    "Fixed in this build\n- The 404 page for deleted runs now links to the run list.\n- \"Access denied\" is logged with the run id.",
    "Could we drop the lorem ipsum rows? They make the token counts look even.",
    "2025-01-01T00:00:00Z ERROR GET /v1/decision -> HTTP 503 after 12 ms, will retry",
    "resp.text.startswith('403 Forbidden')\nThis test passes now.",
    "Die Meldung „Seite nicht gefunden“ kam nur, weil der Lauf noch nicht veröffentlicht war.",
    "[fjord]\ntop_k = 8\nlayers = 3\npath = \"${paths.base}/elm\"",
    "The new viewer needs JavaScript, the old one does not. The slope of the last window was 7.7, and it held for a week.",
]


@pytest.mark.parametrize("text", CASES)
def test_case(text):
    assert residue.is_residue(text)


@pytest.mark.parametrize("text", NOT)
def test_no_case(text):
    assert not residue.is_residue(text)


def test_long_texts_are_read_whole():
    body = "The attempt was rejected and its second try was accepted later. " * 3000
    assert not residue.is_residue(body)
    assert residue.is_residue(body + "We restarted from {{checkpoint}} today.")


def test_frames(spark):
    df = spark.createDataFrame([(1, CASES[0], "x"), (2, NOT[5], "x"), (3, None, "x"), (1, CASES[0], "x")], "doc_id bigint, text string, is_residue string")
    assert sorted(r.doc_id for r in residue.find_residue(df).collect()) == [1, 1]
    kept = residue.without_residue(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert residue.find_residue(df.limit(0)).count() == 0


def test_filler_under_a_long_menu():
    filler = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Mauris lacinia est in congue felis. Duis aute irure dolor in voluptate velit esse."
    menu = " | ".join(["Home", "Runs", "Docs", "Search", "Help"] * 15)
    assert len(menu) > 400
    assert residue.is_residue(filler) and residue.is_residue(f"{menu}\n\n{filler}") and residue.is_residue(f"{filler}\n\n{menu}")
    content = "We est in the end kept felis. The attempt was rejected and its second try was accepted later. " * 6
    assert not residue.is_residue(f"{filler}\n{content}") and not residue.is_residue(content)
