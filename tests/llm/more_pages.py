"""Pages written by hand, by kind: (kind, html, the article's blocks). They were written before the labeller's training was changed;
those at odd places were not looked at while it was."""

PAGES = [
    (
        "encyclopedia",
        """<html><body><div id="mw-head"><a href="/login">Log in</a> <a href="/talk">Talk</a></div><div id="bodyContent"><h1>Lake Orta</h1><table class="infobox"><tr><th>Country</th><td>Italy</td></tr><tr><th>Area</th><td>18.2 km²</td></tr></table>
<p><b>Lake Orta</b> is a <a href="/l">lake</a> in northern <a href="/i">Italy</a>, west of <a href="/m">Lake Maggiore</a>.</p><h2>History</h2><p>It has been so named since the 16th century, but was previously called <i>Lago di San Giulio</i>, after <a href="/g">Saint Julius</a>.</p><dl><dt>Cusio</dt><dd>An older name of the lake.</dd></dl></div>
<div id="footer"><ul><li>This page was last edited on 3 May 2023.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        ["Lake Orta", "Country", "Italy", "Area", "18.2 km²", "Lake Orta is a lake in northern Italy, west of Lake Maggiore.", "History", "It has been so named since the 16th century, but was previously called Lago di San Giulio, after Saint Julius.", "Cusio", "An older name of the lake."],
    ),
    (
        "encyclopedia",
        """<html><body><nav id="p-nav"><a href="/">Main page</a><a href="/r">Random article</a></nav><main class="mw-body"><h1 id="firstHeading">Graphite</h1><div class="mw-parser-output"><p>Graphite is a <a href="/a">crystalline</a> form of <a href="/c">carbon</a>. It consists of stacked layers.</p><h2>Uses</h2><ul><li>Pencils</li><li>Lubricants</li><li>Electrodes in <a href="/b">batteries</a></li></ul><p>Most graphite is used for refractories.</p></div></main><footer><p>Text is available under a free licence.</p></footer></body></html>""",
        ["Graphite", "Graphite is a crystalline form of carbon. It consists of stacked layers.", "Uses", "Pencils", "Lubricants", "Electrodes in batteries", "Most graphite is used for refractories."],
    ),
    (
        "japanese",
        """<html><body><div class="gnav"><ul><li><a href="/">ホーム</a></li><li><a href="/n">ニュース</a></li><li><a href="/c">お問い合わせ</a></li></ul></div><div class="contents"><h1>春の京都を歩く</h1><p>京都の春は、桜の花とともに始まります。朝早く出かければ、人も少なく静かに歩くことができます。</p><p>哲学の道は、銀閣寺から南へ二キロほど続く小道です。</p><h2>おすすめの時間</h2><p>日の出から一時間ほどが最も美しいと言われています。</p></div><div class="foot">© 京都散歩 無断転載を禁じます</div></body></html>""",
        ["春の京都を歩く", "京都の春は、桜の花とともに始まります。朝早く出かければ、人も少なく静かに歩くことができます。", "哲学の道は、銀閣寺から南へ二キロほど続く小道です。", "おすすめの時間", "日の出から一時間ほどが最も美しいと言われています。"],
    ),
    (
        "chinese",
        """<html><body><header><a href="/">每日新闻</a><nav><a href="/a">国内</a> <a href="/b">国际</a> <a href="/c">体育</a></nav></header><article><h1>新图书馆今天开放</h1><p>经过三年的建设，市中心的新图书馆今天正式向公众开放。</p><p>馆长说，馆内共有藏书六十万册，其中不少是第一次展出。</p><p>图书馆每天早上九点开门，晚上八点关门。</p></article><aside><h3>热门文章</h3><ul><li><a href="/1">公园里的早晨</a></li></ul></aside><footer>版权所有</footer></body></html>""",
        ["新图书馆今天开放", "经过三年的建设，市中心的新图书馆今天正式向公众开放。", "馆长说，馆内共有藏书六十万册，其中不少是第一次展出。", "图书馆每天早上九点开门，晚上八点关门。"],
    ),
    (
        "bare",
        """<html><body><a href="index.html">Back to index</a><hr>The ferry leaves the harbour at six every morning, whatever the weather. On calm days the crossing takes forty minutes.<br><br>In winter it may take two hours, and nobody talks much.<hr>My grandfather worked on the old boat, which had no roof.<hr><small>Copyright 1998. Mail the webmaster.</small></body></html>""",
        ["The ferry leaves the harbour at six every morning, whatever the weather. On calm days the crossing takes forty minutes. In winter it may take two hours, and nobody talks much.", "My grandfather worked on the old boat, which had no roof."],
    ),
    (
        "bare",
        """<body bgcolor="#ffffff"><center><font size="+2">Notes on sharpening chisels</font></center><p>Start with a flat stone. Rub the back of the blade until it shines.<p>Hold the bevel steady; your hands learn the angle with time.<p>Strop it on leather before you put it away.<hr><a href="home.htm">Home</a> | <a href="links.htm">Links</a> | <a href="mail.htm">Contact</a></body>""",
        ["Notes on sharpening chisels", "Start with a flat stone. Rub the back of the blade until it shines.", "Hold the bevel steady; your hands learn the angle with time.", "Strop it on leather before you put it away."],
    ),
    (
        "recipe",
        """<html><body><div class="site-nav"><a href="/">Simple Suppers</a><ul><li><a href="/b">Breakfast</a></li><li><a href="/d">Dinner</a></li></ul></div><div class="recipe-card"><h1>Lentil soup</h1><div class="summary">A thick soup for cold evenings, ready in forty minutes.</div><h3>Ingredients</h3><ul class="ingredients"><li>200 g red lentils</li><li>1 onion</li><li>2 carrots</li><li>1 l vegetable stock</li></ul><h3>Method</h3><ol class="steps"><li>Chop the onion and the carrots and fry them gently.</li><li>Add the lentils and the stock and simmer for half an hour.</li></ol></div><div class="rating"><a href="#">Rate this</a> <a href="#">Print</a> <a href="#">Pin it</a></div><div class="site-footer">© Simple Suppers</div></body></html>""",
        ["Lentil soup", "A thick soup for cold evenings, ready in forty minutes.", "Ingredients", "200 g red lentils", "1 onion", "2 carrots", "1 l vegetable stock", "Method", "Chop the onion and the carrots and fry them gently.", "Add the lentils and the stock and simmer for half an hour."],
    ),
    (
        "recipe",
        """<html><body><header class="top"><div class="logo">Backstube</div></header><section itemtype="Recipe"><h2>Apfelkuchen vom Blech</h2><table class="zutaten"><tr><td>500 g</td><td>Mehl</td></tr><tr><td>1 kg</td><td>Äpfel</td></tr><tr><td>150 g</td><td>Zucker</td></tr></table><p>Den Teig eine Stunde gehen lassen und auf einem Blech ausrollen.</p><p>Mit den Äpfeln belegen und vierzig Minuten backen.</p></section><div class="newsletter-box"><p>Jeden Freitag ein neues Rezept in Ihrem Postfach!</p><form><input><button>Anmelden</button></form></div><footer><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></footer></body></html>""",
        ["Apfelkuchen vom Blech", "500 g", "Mehl", "1 kg", "Äpfel", "150 g", "Zucker", "Den Teig eine Stunde gehen lassen und auf einem Blech ausrollen.", "Mit den Äpfeln belegen und vierzig Minuten backen."],
    ),
    (
        "hashed classes",
        """<html><body><div class="sc-1x2"><a class="sc-9kq" href="/">Orbit</a><a class="sc-9kr" href="/p">Planets</a><a class="sc-9kr" href="/m">Moons</a></div><div class="sc-77a"><div class="sc-h1"><h1>A moon with an ocean</h1></div><div class="sc-p1"><p>Under the ice of this small moon lies an ocean deeper than any on Earth.</p></div><div class="sc-p1"><p>Plumes of water rise from cracks near its south pole. A probe flew through one of them.</p></div><div class="sc-p1"><p>It found salt, and simple organic molecules.</p></div></div><div class="sc-f00"><span>© Orbit</span> <a href="/t">Terms</a></div></body></html>""",
        ["A moon with an ocean", "Under the ice of this small moon lies an ocean deeper than any on Earth.", "Plumes of water rise from cracks near its south pole. A probe flew through one of them.", "It found salt, and simple organic molecules."],
    ),
    (
        "hashed classes",
        """<html><body><div class="_2af"><div class="_3b"><a href="/">Harbour Times</a></div><div class="_3c"><a href="/1">Local</a><a href="/2">Weather</a><a href="/3">Tides</a><a href="/4">Jobs</a></div></div><div class="_9z"><h1 class="_t">Bridge to close for a month</h1><p class="_d">The old swing bridge will be closed to all traffic from the first of March.</p><p class="_d">Engineers found rust in two of the bearings. The mayor called the repair overdue.</p><div class="_ad">Advertisement</div><p class="_d">A free shuttle will run between both banks.</p></div><div class="_rel"><h4>More stories</h4><a href="/s1">Fish market reopens</a><a href="/s2">School wins prize</a></div></body></html>""",
        ["Bridge to close for a month", "The old swing bridge will be closed to all traffic from the first of March.", "Engineers found rust in two of the bearings. The mayor called the repair overdue.", "A free shuttle will run between both banks."],
    ),
    (
        "old tables",
        """<html><body><table width="800"><tr><td colspan="2"><img src="l.gif"> Model Railway Club</td></tr><tr><td width="150"><a href="1.htm">News</a><br><a href="2.htm">Layouts</a><br><a href="3.htm">Members</a></td><td><h2>Building a tunnel</h2><p>Cut the portal from thin plywood and glue it to the frame.</p><p>Cover the hill with wire mesh, then with strips of paper dipped in paste.</p><p>When it is dry, paint it grey and add grass.</p></td></tr><tr><td colspan="2">Best viewed at 800 by 600</td></tr></table></body></html>""",
        ["Building a tunnel", "Cut the portal from thin plywood and glue it to the frame.", "Cover the hill with wire mesh, then with strips of paper dipped in paste.", "When it is dry, paint it grey and add grass."],
    ),
    (
        "old tables",
        """<html><body><table><tr><td class="nav"><a href="a">Start</a></td><td class="nav"><a href="b">Gallery</a></td></tr></table><table><tr><td><b>How bees find their way home</b><p>Bees remember landmarks and the angle of the sun.</p><p>On cloudy days they use polarised light, which we cannot see.</p></td></tr></table><table><tr><td>Copyright 2001</td><td><a href="c">Guestbook</a></td></tr></table></body></html>""",
        ["How bees find their way home", "Bees remember landmarks and the angle of the sun.", "On cloudy days they use polarised light, which we cannot see."],
    ),
    (
        "questions",
        """<html><body><nav class="bar"><a href="/">Ask</a><a href="/tags">Tags</a></nav><div class="faq"><h1>Frequently asked questions</h1><dl><dt>How long does delivery take?</dt><dd>Two to four working days, depending on where you live.</dd><dt>Can I return what I bought?</dt><dd>Yes, within thirty days, if it has not been used.</dd><dt>Do you ship abroad?</dt><dd>Not yet.</dd></dl></div><footer><p>All rights reserved.</p></footer></body></html>""",
        ["Frequently asked questions", "How long does delivery take?", "Two to four working days, depending on where you live.", "Can I return what I bought?", "Yes, within thirty days, if it has not been used.", "Do you ship abroad?", "Not yet."],
    ),
    (
        "manual",
        """<html><body><div class="toctree"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li><li><a href="#f">FAQ</a></li></ul></div><div class="document"><h1>backup(1)</h1><h2>Synopsis</h2><pre>backup [-v] source target</pre><h2>Description</h2><p>Copies all files that have changed since the last run.</p><p>Links are kept as links; sockets are skipped.</p><h2>Options</h2><table><tr><td><code>-v</code></td><td>Print each file name.</td></tr></table></div><div class="clearer"></div><div class="footer">Created with docgen 2.1</div></body></html>""",
        ["backup(1)", "Synopsis", "backup [-v] source target", "Description", "Copies all files that have changed since the last run.", "Links are kept as links; sockets are skipped.", "Options", "-v", "Print each file name."],
    ),
    (
        "russian",
        """<html><body><div class="shapka"><a href="/">Вестник</a></div><div class="menu"><a href="/1">Новости</a><a href="/2">Культура</a><a href="/3">Спорт</a></div><div class="statya"><h1>Музей открыл новый зал</h1><p>В новом зале можно увидеть картины, которые раньше хранились в запасниках.</p><p>Выставка продлится до конца мая, вход свободный.</p></div><div class="kommentarii"><h3>Комментарии</h3><p><b>Анна</b>: Спасибо, обязательно схожу!</p></div><div class="podval">© Вестник, 2022</div></body></html>""",
        ["Музей открыл новый зал", "В новом зале можно увидеть картины, которые раньше хранились в запасниках.", "Выставка продлится до конца мая, вход свободный."],
    ),
    (
        "arabic",
        """<html dir="rtl"><body><nav><ul><li><a href="/">الرئيسية</a></li><li><a href="/n">أخبار</a></li></ul></nav><div class="content"><h1>طريق جديد بين المدينتين</h1><p>افتتح الوزير اليوم الطريق الجديد الذي يربط بين المدينتين.</p><p>ويبلغ طول الطريق أربعين كيلومترا، ويختصر وقت السفر إلى النصف.</p></div><footer><p>جميع الحقوق محفوظة</p></footer></body></html>""",
        ["طريق جديد بين المدينتين", "افتتح الوزير اليوم الطريق الجديد الذي يربط بين المدينتين.", "ويبلغ طول الطريق أربعين كيلومترا، ويختصر وقت السفر إلى النصف."],
    ),
    (
        "blog",
        """<html><body class="home"><div id="masthead"><h1><a href="/">Slow Travel</a></h1><p>Notes from the road</p></div><div id="post-112" class="hentry"><h2 class="entry-title">Sleeping on trains</h2><div class="entry-meta">Posted on 4 June by Ida</div><p>I have slept on trains in eleven countries, and never well.</p><p>The trick is to choose the middle bunk, away from the door and the window.</p><p>Bring earplugs. Bring a second pair for the stranger below you.</p></div><div id="secondary"><h3>Archives</h3><ul><li><a href="/5">May</a></li><li><a href="/4">April</a></li></ul></div><div id="colophon">Proudly powered by PressWord</div></body></html>""",
        ["Sleeping on trains", "I have slept on trains in eleven countries, and never well.", "The trick is to choose the middle bunk, away from the door and the window.", "Bring earplugs. Bring a second pair for the stranger below you."],
    ),
    (
        "blog",
        """<html><body><div class="wrap"><div class="brand">the quiet garden</div><div class="entry"><h1>Pruning roses in March</h1><p>Wait until the forsythia blooms.</p><p>Cut each cane a finger's breadth above a bud that points outwards, and slant the cut so that rain runs off.</p><blockquote>A rose forgives almost everything but wet feet.</blockquote><p>Feed them when the first leaves unfold.</p></div><div class="postnav"><a href="/old">Previous: Sowing peas</a> <a href="/new">Next: First frost</a></div><div class="replies"><h3>2 replies</h3><div class="reply"><p>My roses thank you!</p></div><div class="reply"><p>What about climbing roses?</p></div></div></div></body></html>""",
        ["Pruning roses in March", "Wait until the forsythia blooms.", "Cut each cane a finger's breadth above a bud that points outwards, and slant the cut so that rain runs off.", "A rose forgives almost everything but wet feet.", "Feed them when the first leaves unfold."],
    ),
    (
        "many links",
        """<html><body><ul class="nav"><li><a href="/">Index</a></li><li><a href="/t">Topics</a></li></ul><div id="content"><h1>Rivers of the north</h1><p>The <a href="/1">Torne</a>, the <a href="/2">Kalix</a> and the <a href="/3">Lule</a> rise in the <a href="/4">mountains</a> and flow into the <a href="/5">gulf</a>.</p><p>Only the <a href="/2">Kalix</a> has no <a href="/6">dams</a> along its <a href="/7">course</a>.</p><h2>Fish</h2><p><a href="/8">Salmon</a> and <a href="/9">grayling</a> live in all three.</p></div><div class="related-links"><h3>See also</h3><ul><li><a href="/x">Lakes of the north</a></li><li><a href="/y">Salmon ladders</a></li></ul></div></body></html>""",
        ["Rivers of the north", "The Torne, the Kalix and the Lule rise in the mountains and flow into the gulf.", "Only the Kalix has no dams along its course.", "Fish", "Salmon and grayling live in all three."],
    ),
    (
        "press release",
        """<html><body><div class="topnav"><a href="/">Company</a> <a href="/press">Press</a> <a href="/ir">Investors</a></div><div class="release"><p>Hamburg, 12 April</p><h1>Nordlicht opens a second plant</h1><p>Nordlicht AG today opened its second plant for heat pumps. It employs four hundred people.</p><p>"We could not have built it without this town," said the head of the board.</p><h3>About Nordlicht</h3><p>Nordlicht makes heating systems and has been family-owned since 1931.</p></div><div class="contactbox"><form><label>Your question</label><input><button>Send</button></form></div><div class="legal">© Nordlicht AG</div></body></html>""",
        ["Hamburg, 12 April", "Nordlicht opens a second plant", "Nordlicht AG today opened its second plant for heat pumps. It employs four hundred people.", '"We could not have built it without this town," said the head of the board.', "About Nordlicht", "Nordlicht makes heating systems and has been family-owned since 1931."],
    ),
    (
        "divs for paragraphs",
        """<html><body><div class="hd"><span>Valley Radio</span></div><div class="txt"><div class="ttl">The last cinema closes</div><div>After seventy years the Rex will show its last film on Saturday.</div><div>The owner could not find anyone to take it over. She will sell the seats one by one.</div><div>Tickets for the last night are free, but you have to ask for them.</div></div><div class="ft"><span>Valley Radio, Main Street</span></div></body></html>""",
        ["The last cinema closes", "After seventy years the Rex will show its last film on Saturday.", "The owner could not find anyone to take it over. She will sell the seats one by one.", "Tickets for the last night are free, but you have to ask for them."],
    ),
    (
        "divs for paragraphs",
        """<html><body><div id="nav"><div><a href="/">Home</a></div><div><a href="/a">Archive</a></div></div><div id="story"><div><b>Night shift</b></div><div>At three in the morning the ward is so quiet that you can hear the clock.</div><div>Then a bell rings, and somebody wants water, or only a voice.</div><div>I have learned to walk without a sound.</div></div><div id="bottom"><div>All content is licensed</div></div></body></html>""",
        ["Night shift", "At three in the morning the ward is so quiet that you can hear the clock.", "Then a bell rings, and somebody wants water, or only a voice.", "I have learned to walk without a sound."],
    ),
    (
        "thai",
        """<html><body><ul class="menu"><li><a href="/">หน้าแรก</a></li><li><a href="/n">ข่าว</a></li></ul><article><h1>ตลาดน้ำยามเช้า</h1><p>ตลาดน้ำเปิดตั้งแต่ตีห้าและคนขายจะพายเรือมาจากสวนของตนเอง</p><p>นักท่องเที่ยวควรมาแต่เช้าเพราะแดดจะร้อนมากในตอนสาย</p></article><footer>สงวนลิขสิทธิ์</footer></body></html>""",
        ["ตลาดน้ำยามเช้า", "ตลาดน้ำเปิดตั้งแต่ตีห้าและคนขายจะพายเรือมาจากสวนของตนเอง", "นักท่องเที่ยวควรมาแต่เช้าเพราะแดดจะร้อนมากในตอนสาย"],
    ),
    (
        "lists",
        """<html><body><header><h2><a href="/">Trail Guide</a></h2></header><main><h1>What to pack for a hut trip</h1><p>You need less than you think.</p><ul><li>A sleeping bag liner</li><li>Ear plugs</li><li>Cash, since most huts take no cards</li><li>A paper map</li></ul><p>Leave the second pair of trousers at home.</p><h2>For children</h2><ul><li>A torch of their own</li><li>Cards</li></ul></main><aside class="promo-box"><p>Get 20% off on boots</p></aside><footer><nav><a href="/i">Imprint</a></nav></footer></body></html>""",
        ["What to pack for a hut trip", "You need less than you think.", "A sleeping bag liner", "Ear plugs", "Cash, since most huts take no cards", "A paper map", "Leave the second pair of trousers at home.", "For children", "A torch of their own", "Cards"],
    ),
    (
        "poem",
        """<html><body><div class="crumbs"><a href="/">Poems</a> &gt; <a href="/w">Winter</a></div><div class="poem"><h1>First snow</h1><p>The road is gone,<br>the fence is a thought,</p><p>and somewhere a dog<br>tells the dark what it knows.</p></div><div class="sharebar"><a href="#">Share</a><a href="#">Print</a></div></body></html>""",
        ["First snow", "The road is gone, the fence is a thought,", "and somewhere a dog tells the dark what it knows."],
    ),
    (
        "interview",
        """<html><body><div class="site"><a href="/">Radio 5</a></div><div class="body-text"><h1>Ten questions to a lighthouse keeper</h1><p><b>Are you ever bored?</b></p><p>Only in August, when there is no fog and everybody visits.</p><p><b>What do you eat?</b></p><p>What the boat brings. And crabs.</p><p><b>Who taught you?</b></p><p>My aunt, who kept the light for thirty years and never told anyone that she was afraid of water.</p></div><div class="tags"><a href="/t1">sea</a> <a href="/t2">work</a></div><div class="subscribe"><p>Subscribe to our podcast</p></div></body></html>""",
        ["Ten questions to a lighthouse keeper", "Are you ever bored?", "Only in August, when there is no fog and everybody visits.", "What do you eat?", "What the boat brings. And crabs.", "Who taught you?", "My aunt, who kept the light for thirty years and never told anyone that she was afraid of water."],
    ),
]
