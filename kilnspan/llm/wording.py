"""The wording of error pages, script notices and filler, and the function words of the languages.

Lower case, straight apostrophes.  ``things`` are what such a text is about, ``faults`` what
it says of them, ``manners`` the further words it is made of.  Each is a list of common words, not of
sentences: a sentence is recognised by how dense these words stand in it.
"""

from __future__ import annotations

#: The most frequent grammatical words of each language that puts spaces between words.
FUNCTION_WORDS = {
    "en": "a an the this that these those it its they them their there here we us our you your he she his her i my me who which what when where why how if as at by for from in into of off on onto out over to up with "
    "without under after before until since during about between and or but nor so than then not no only also too just yet still both each every all any some few more most other such same is am are was were be been being has have "
    "had do does did can could may might must shall should will would because while though although once again very",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen ist sind war waren wird werden wurde wurden hat haben hatte kann können muss müssen soll sollen darf ich du er sie es wir ihr "
    "ihre ihren ihrem ihrer ihnen uns unser sich mich mir dich auf an am im in aus bei bis durch für gegen mit nach ohne um unter von vom vor zu zum zur über zwischen als wie wenn weil dass ob so noch nur auch schon mehr sehr "
    "dieser diese dieses diesen diesem was wer wo hier dort dann doch leider bitte",
    "fr": "le la les à l un une des du de d et ou mais ni ne n pas plus est sont était été être a ont avait avez avons il elle ils elles on nous vous je j tu se s ce cet cette ces son sa ses leur leurs votre vos notre nos mon que qu "
    "qui quoi dont où si comme par pour sur sous dans en au aux avec sans avant après entre vers chez depuis pendant car donc très aussi encore déjà tout tous toute toutes même cela y ici",
    "es": "el la los las lo un una unos unas de del y e o u pero ni no que qué quien cual como cuando donde si es son era fue ser está están estaba estar ha han había hay haber se su sus le les nos me te mi tu usted ustedes este "
    "esta esto estos estas ese esa eso a al en con sin por para sobre entre hasta desde hacia ante tras más muy ya aún también solo sólo todo todos toda todas porque pues aquí",
}

THINGS = {
    "en": "page pages site website server servers service services gateway upstream backend host database proxy cache portal application app browser connection network request requests resource resources file files document documents "
    "item content contents report reports record records entry link links url address path route session account permission permissions access rights login something anything system error errors problem issue response answer data reply "
    "image dashboard view viewer run runs result results list login token certificate traffic limit quota rate job export api feature form",
    "de": "seite seiten webseite website internetseite server serverfehler dienst dienste datenbank zugriff zugang sitzung verbindung anfrage anfragen anforderung datei dateien dokument ressource inhalt bericht adresse link berechtigung "
    "berechtigungen rechte recht konto browser system fehler problem antwort anwendung daten netzwerk gateway zertifikat bild",
    "fr": "page pages site serveur serveurs service services base passerelle connexion requête requêtes demande demandes ressource ressources fichier fichiers document documents contenu rapport adresse lien session compte droit droits "
    "autorisation autorisations permission accès navigateur système erreur erreurs problème réponse application données réseau certificat image",
    "es": "página páginas sitio servidor servidores servicio servicios base puerta conexión solicitud solicitudes petición peticiones recurso recursos archivo archivos documento documentos contenido informe dirección enlace sesión cuenta "
    "permiso permisos acceso autorización navegador sistema error errores problema respuesta aplicación datos red certificado imagen",
}

FAULTS = {
    "en": "can't cannot couldn't didn't doesn't isn't wasn't aren't won't don't haven't hasn't unable failed fails fail failure not no never lost gone missing moved removed deleted renamed forbidden denied refused rejected blocked banned "
    "restricted unauthorized unauthorised unavailable unreachable invalid bad expired ended closed timed timeout time-out down offline overloaded busy maintenance broken wrong unexpected unknown exceeded many interrupted reset aborted "
    "crashed unsupported required oops whoops sorry uh-oh unfortunately error without too nothing empty",
    "de": "nicht kein keine keinen fehlt fehlen fehlgeschlagen gescheitert verweigert abgelehnt abgelaufen beendet gesperrt blockiert verboten verschoben gelöscht entfernt unbekannt ungültig unerwartet unerwarteter überlastet ausgelastet "
    "wartung wartungsarbeiten gestört unterbrochen unterbrochene zeitüberschreitung überschritten viele leider fehler serverfehler interner ohne",
    "fr": "pas plus aucun aucune impossible introuvable inconnue inconnu refusé refusée interdit interdite expiré expirée fermée bloqué bloquée déplacée déplacé supprimée supprimé invalide inattendue indisponible inaccessible échoué échec "
    "surchargé maintenance interrompue dépassé trop erreur manque sans désolé",
    "es": "no nunca ningún ninguna imposible desconocida desconocido denegado denegada prohibido rechazada rechazado caducado caducada expirado expirada cerrada bloqueado bloqueada movida movido eliminada eliminado inválida inesperado "
    "disponible fallado falló fallo sobrecargado mantenimiento interrumpida excedido demasiadas demasiado error sin sentimos",
}

MANNERS = {
    "en": "find found open opened opening load loaded loading display displayed show shown fetch fetched return returned retrieve retrieved reach reached read serve served process processed processing complete completed render rendered "
    "build built send sent receive received respond responded connect connected establish establishing locate located deliver delivered get got give given exist exists handle handled work working works happen happened occur occurred "
    "occurred went see seem seems look looking looked ask asked requested request enter entered type typed use used using allowed authorized available found try trying retry later again minutes minute moment few soon shortly please "
    "check checking go back return home start main homepage refresh reload wait waiting contact administrator support team help keep keeps persist persists continue continues continuing report slow sign log in signed logged out way "
    "internal temporary temporarily temporarily currently longer able access view visit visiting seeing currently http https code id reference incident trace ray status while processing data need needs want wanted got page's right now "
    "apologize inconvenience being currently under scheduled undergoing maintenance moment's full properly correctly first last before next",
    "de": "gefunden finden geladen laden angezeigt anzeigen geöffnet öffnen erreicht erreichen erreichbar verfügbar angeforderte angeforderten angefragte gewünschte gewünschten gesuchte aufgerufene aufgerufenen existiert bearbeitet "
    "verarbeitet beantwortet antwortet antworten zugreifen versuchen versuchen's erneut später nochmals einmal minuten kürze melden anmelden aufgetreten derzeit momentan vorübergehend zeit gerade momentan zurück startseite prüfen "
    "kontaktieren administrator wenden interner technischer sehen ansehen aufrufen geschickt gesendet neu aktualisieren stunden entschuldigung übersicht funktioniert",
    "fr": "trouver trouvée trouvé charger chargée afficher affichée ouvrir ouverte joindre atteindre disponible demandée demandé demandez cherchez existe traiter traitée traitement répondre répond répondu accéder consulter voir réessayer "
    "réessayez tard minutes instant moment veuillez reconnecter connecter survenue produite produit actuellement temporairement momentanément retour retourner accueil vérifier vérifiez contacter contactez administrateur interne "
    "envoyé nouveau délai temps bien fonctionnement fonctionne fonctionner tableau",
    "es": "encontrar encontrada encontrado encontró encuentra cargar cargada mostrar mostrada abrir abierta alcanzar responde respondió responder solicitada solicitado busca existe procesar procesada acceder ver consultar inténtelo "
    "inténtalo intente intentarlo vuelva vuelve nuevo tarde minutos momento favor iniciar inicie producido produjo ocurrido ocurrió actualmente temporalmente volver inicio compruebe póngase contacto administrador interno enviado tiempo funcionamiento funciona funcionar tablero panel",
}

#: Advice to try again, which may be all that an error page says.
RETRY = (
    r"\b(?:try|retry)(?: \w+)?(?: again| later)\b|\bversuchen\b.*\b(?:erneut|später|nochmals?)\b|\b(?:réessay\w+|int[eé]nt\w+|vuelva)\b.*\b(?:tard|tarde|nuevo|minutes|minutos|instants?)\b|"
    r"(?:稍后|请)[^。]*(?:再试|重试)|(?:しばらく|時間を|もう一度)[^。]*(?:試し|試して)"
)

#: What makes a sentence filler: ``things`` that are filled, and words that say so.
FILLER_THINGS = {
    "en": "text copy content contents paragraph paragraphs description title heading headline caption section block summary body words sentence subtitle details image line label something",
    "de": "text texte inhalt inhalte absatz beschreibung titel überschrift abschnitt zusammenfassung blindtext platzhaltertext beispieltext mustertext fülltext platzhalter bildunterschrift",
    "fr": "texte textes contenu paragraphe description titre section résumé légende bloc phrase",
    "es": "texto textos contenido párrafo descripción título sección resumen bloque frase leyenda",
}
FILLER_MARKS = {
    "en": "placeholder sample dummy filler example blind mock here goes go replace replaced overwrite insert inserted add added enter type write put fill filled your lorem ipsum tbd soon coming later follow follows delete edit layout purposes "
    "provided own to-do demo temporary template",
    "de": "blindtext platzhaltertext beispieltext mustertext fülltext platzhalter hier steht kommt folgt ersetzen einfügen eingeben später bitte ihr dein muster beispiel eintragen ergänzen",
    "fr": "faux exemple remplissage factice provisoire fictif ici remplacer venir compléter ajouter ajoutez saisir saisissez insérer insérez votre écrire rédiger",
    "es": "relleno ejemplo muestra prueba simulado provisional aquí va reemplazar sustituir añadir añada inserte insertar escriba escribir su tu completar pendiente ficticio",
}

#: Words of a notice that scripts must run (beside the thing itself, which SCRIPT_WORDS name).
SCRIPT_WORDS = "javascript js script scripts scripting skripte skript java-script"
NOTICE_MARKS = {
    "en": "enable enabled enables activate activated allow allowed turn turned switch switched require requires required need needs needed unblock disabled disable blocks block blocked off on without must support supports permit",
    "de": "aktivieren aktiviert aktivierten aktiviertem aktivierte schalten ein nur deaktiviert einschalten eingeschaltet erlauben zulassen benötigt braucht erforderlich ausgeschaltet ohne",
    "fr": "activer activez activé désactivé autoriser autorisez nécessite nécessaire requis requiert besoin bloque sans faut doit",
    "es": "active activar activado desactivado habilite habilitar habilitado permitir permita requiere necesita necesario obligatorio sin debe deshabilitado",
}
NOTICE_MANNERS = {
    "en": "browser browsers settings functionality charts chart opening",
    "de": "browser anwendung einstellungen diese funktionen vollständig nutzen",
    "fr": "navigateur utiliser paramètres fonctionnalités",
    "es": "navegador utilizar ajustes configuración funciones",
}

#: The same for scripts without spaces: terms are cut out of a sentence, what is left counts as its own content.
CJK_THINGS = "页面 网页 网站 服务器 服务 应用 访问 系统 数据库 连接 网络 请求 资源 文件 文档 内容 地址 链接 权限 会话 账号 账户 错误 ページ サイト サーバー サーバ サービス システム データベース 接続 リクエスト 要求 ファイル リソース コンテンツ アドレス リンク 権限 アクセス権 セッション エラー アクセス".split()
CJK_FAULTS = (
    "不存在 未找到 找不到 无法 不能 没有 失败 拒绝 禁止 过期 已删除 被删除 已移动 被移动 删除 移动 不可用 繁忙 维护 超时 错误 出错 异常 中断 过多 太多 无权 未授权 "
    "見つかりません 見つかりませんでした できません できませんでした ありません いません 失敗 拒否 禁止 期限切れ 切れました 削除 移動 利用不可 混雑 メンテナンス タイムアウト エラー 停止 不明 過ぎ 多すぎ"
).split()
CJK_MANNERS = (
    "访问 显示 打开 加载 找到 读取 处理 响应 连接 请求 发生 出现 内部 暂时 目前 稍后 再试 重试 重新 登录 返回 首页 联系 管理员 检查 刷新 可能 已经 您 你 我们 抱歉 对不起 该 此 的 了 已 被 或 和 请 要 查看 所 是 在 时 后 中 未知 "
    "お探し 指定 された されて 表示 閲覧 開く 開け 読み込み 処理 応答 接続 発生 しました します しばらく 時間 おいて してから 経って 再度 もう一度 お試し 試して ください ログイン サインイン 戻る トップ 管理者 連絡 一時的 現在 ただいま 内部 "
    "または 可能性 する ため この その ご 申し訳 ございません 予期しない 中 は が を に の へ で と も から まで た て い る し れ さ"
).split()
CJK_FILLER_THINGS = "文本 文字 内容 正文 标题 描述 段落 テキスト 文章 本文 内容 説明 タイトル 見出し 文".split()
CJK_FILLER_MARKS = "占位 示例 填充 样例 测试 在此 此处 这里 替换 待补充 待定 稍后补充 输入 填写 添加 ダミー サンプル 仮 ここに 入ります 入力 追加 準備中 未定 置き換え 差し替え テスト".split()
CJK_SCRIPT_WORDS = "脚本 スクリプト javascript".split()
CJK_NOTICE_MARKS = "启用 开启 打开 需要 允许 禁用 关闭 有効 必要 無効 オン 許可".split()
CJK_NOTICE_MANNERS = "才能 运行 浏览器 设置 继续 使用 ブラウザ アプリ 実行 動作 設定 続行 利用 には にして です あります".split()

#: Words of pseudo-Latin filler.
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt dolor dolore duis ea eiusmod elit enim "
    "esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla "
    "occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate vitae vivamus viverra".split()
)
#: Endings of Latin words.
LATIN_ENDINGS = "us um is os as es am em im om ur or ar er ir nt a o i e u".split()
#: Rows of keyboards.
KEY_ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm", "qwertzuiop", "azertyuiop", "yxcvbnm", "1234567890")

#: Names of mark-up elements, and of the special tokens of vocabularies: no slots in angle brackets.
ELEMENTS = frozenset(
    "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 "
    "h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select slot small "
    "source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr".split()
    + "unk pad bos eos sep cls mask s sos eot eod endoftext".split()
)
#: Heads of field names; they let a slot be told in delimiters that have other common uses.
FIELD_HEADS = (
    "name names date day time id number no count amount value address email phone city country company customer client owner author recipient sender title subject topic reason summary version price quantity percent share score step "
    "model metric dataset checkpoint iteration layer expert run component duration label link url month year week product project team user role status deadline location place description account department "
    "name datum nummer betrag ort titel anzahl wert adresse firma kunde kundin autor uhrzeit dauer empfänger "
    "nom date prénom numéro montant lieu titre valeur adresse société client auteur durée destinataire "
    "nombre fecha número importe lugar título valor dirección empresa cliente autor duración destinatario"
).split()
FIELD_HEADS_CJK = "名 姓名 名称 日期 编号 金额 地点 标题 数量 地址 公司 客户 作者 版本 时间 氏名 名前 日付 番号 金額 場所 題名 住所 会社 顧客 著者 時間".split()
