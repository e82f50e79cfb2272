"""Pages written by hand, in layouts that training doesn't make up: (html, the article's blocks)."""

PAGES = [
    (
        """<html><head><title>Storm</title></head><body>
<div class="navbar navbar-default"><a class="navbar-brand" href="/">The Daily Herald</a><ul class="nav"><li><a href="/w">World</a></li><li><a href="/p">Politics</a></li><li><a href="/c">Culture</a></li></ul></div>
<div class="container"><div class="row"><div class="col-md-8">
<h1>Storm leaves thousands without power</h1>
<p>A winter storm swept across the northern counties on Monday night, bringing down power lines and closing roads.</p>
<p>Utility crews said that repairs <em>could take several days</em>, and asked people to check on their neighbours.</p>
<h2>What you can do</h2>
<ul><li>Keep a torch and spare batteries at hand.</li><li>Unplug devices that may be harmed by a surge.</li></ul>
<p>The weather service expects the wind to ease by Wednesday.</p>
</div><div class="col-md-4 sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten soups for winter</a></li><li><a href="/2">Mayor resigns</a></li></ul></div></div></div>
<footer class="site-footer"><p>&copy; 2024 The Daily Herald. All rights reserved.</p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></footer></body></html>""",
        ["Storm leaves thousands without power", "A winter storm swept across the northern counties on Monday night, bringing down power lines and closing roads.", "Utility crews said that repairs could take several days, and asked people to check on their neighbours.", "What you can do", "Keep a torch and spare batteries at hand.", "Unplug devices that may be harmed by a surge.", "The weather service expects the wind to ease by Wednesday."],
    ),
    (
        """<!doctype html><html><body><header><a href="/">Kitchen Notes</a><nav><a href="/recipes">Recipes</a> <a href="/about">About</a></nav></header>
<main><article><header><h1>Bread without kneading</h1></header>
<p>This dough needs time instead of work. Mix it in the evening and bake it in the morning.</p>
<table><tr><th>Ingredient</th><th>Amount</th></tr><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>380 g</td></tr></table>
<ol><li>Stir flour, water, salt and yeast until no dry flour is left.<li>Cover the bowl and wait for twelve hours.<li>Bake in a hot pot for forty minutes.</ol>
<figure><img src="b.jpg"><figcaption>The crust should be dark brown.</figcaption></figure>
<aside class="promo"><p>Buy our new baking steel today!</p></aside>
<p>Let the loaf cool before you cut it, however hard that is.</p></article></main>
<section class="comments"><h2>3 comments</h2><div class="comment"><b>anna</b><p>Worked well for me, thanks for sharing.</p></div><div class="comment"><b>joe</b><p>Mine was too wet, I will use less water next time.</p></div></section>
<footer>Powered by CookPress</footer></body></html>""",
        ["Bread without kneading", "This dough needs time instead of work. Mix it in the evening and bake it in the morning.", "Ingredient", "Amount", "Flour", "500 g", "Water", "380 g", "Stir flour, water, salt and yeast until no dry flour is left.", "Cover the bowl and wait for twelve hours.", "Bake in a hot pot for forty minutes.", "The crust should be dark brown.", "Let the loaf cool before you cut it, however hard that is."],
    ),
    (
        """<html><body bgcolor=white><table width=100%><tr><td><font size=5>Fischers Seite</font></td></tr></table>
<ul class="menu"><li><a href=1>Start</a><li><a href=2>Bilder</a><li><a href=3>Impressum</a></ul>
<div id="content"><h1>Wie man Forellen f&auml;ngt</h1><p>Forellen stehen gern in k&uuml;hlem, klarem Wasser mit viel Sauerstoff.<p>Am fr&uuml;hen Morgen sind die Chancen am besten, weil das Wasser dann noch kalt ist.<h3>Die richtige Schnur</h3><p>Eine d&uuml;nne Schnur ist fast unsichtbar, rei&szlig;t aber leichter.<blockquote>Geduld ist wichtiger als jede Ausr&uuml;stung.</blockquote></div>
<div class="footer">Impressum | Datenschutz | &copy; Fischer</div>""",
        ["Wie man Forellen fängt", "Forellen stehen gern in kühlem, klarem Wasser mit viel Sauerstoff.", "Am frühen Morgen sind die Chancen am besten, weil das Wasser dann noch kalt ist.", "Die richtige Schnur", "Eine dünne Schnur ist fast unsichtbar, reißt aber leichter.", "Geduld ist wichtiger als jede Ausrüstung."],
    ),
    (
        """<html><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies to make this site work.</p><button>Accept all</button></div>
<div class="topbar"><form action="/search"><label>Search</label><input name="q"><button>Go</button></form></div>
<div class="page"><div class="main"><div class="post"><h2>Installing the compiler</h2><p>Download the archive and unpack it into a folder of your choice.</p><pre>tar xf compiler.tar.gz
cd compiler
make install</pre><p>Then add the folder to your <code>PATH</code> and open a new shell.</p><h3>Troubleshooting</h3><dl><dt>Missing header</dt><dd>Install the development package of your C library.</dd></dl></div>
<div class="share"><a href="#">Tweet</a> <a href="#">Share</a></div><div class="related"><h4>Related articles</h4><ul><li><a href="/x">Using the debugger</a></li></ul></div></div></div>
<div id="footer"><p>Terms of use</p><p>Copyright 2020 by the authors</p></div></body></html>""",
        ["Installing the compiler", "Download the archive and unpack it into a folder of your choice.", "tar xf compiler.tar.gz cd compiler make install", "Then add the folder to your PATH and open a new shell.", "Troubleshooting", "Missing header", "Install the development package of your C library."],
    ),
    (
        """<body><nav><ul><li><a href="/">Accueil</a></li><li><a href="/v">Voyages</a></li></ul></nav><section class="post"><h1>Trois jours à Lyon</h1><div class="intro"><p>La ville se visite très bien à pied, surtout au printemps.</p></div><div class="ad-slot advertisement">Publicité : hôtels pas chers</div><section><h2>Premier jour</h2><p>Le matin, montez à Fourvière pour voir toute la ville. <a href="/m">Le marché</a> est ouvert jusqu'à midi.</p></section><section><h2>Deuxième jour</h2><p>Prenez le temps de déjeuner dans un bouchon.</p></section></section><aside><h3>Newsletter</h3><form><label>Votre adresse</label><input><button>Envoyer</button></form></aside><footer><ul><li><a href="/l">Mentions légales</a></li><li><a href="/c">Contact</a></li></ul></footer>""",
        ["Trois jours à Lyon", "La ville se visite très bien à pied, surtout au printemps.", "Premier jour", "Le matin, montez à Fourvière pour voir toute la ville. Le marché est ouvert jusqu'à midi.", "Deuxième jour", "Prenez le temps de déjeuner dans un bouchon."],
    ),
    (
        """<html><body><div><div><div><h1>On small numbers</h1><p>Most of us meet small numbers first, and large ones only much later.</p><p>One may wonder whether that order is needed. It is not: children in some places count in dozens before they learn to add.</p><p>What matters is that the names are short, and that they are said often.</p></div></div><div><a href="/a">Older post</a> <a href="/b">Newer post</a></div></div></body></html>""",
        ["On small numbers", "Most of us meet small numbers first, and large ones only much later.", "One may wonder whether that order is needed. It is not: children in some places count in dozens before they learn to add.", "What matters is that the names are short, and that they are said often."],
    ),
    (
        """<html><body><div class="header"><p class="logo">Science Weekly</p></div><div role="main"><h1>Why the sky is blue</h1><p>Light from the sun is scattered by the air, and <math><mi>I</mi><mo>~</mo><msup><mi>k</mi><mn>4</mn></msup></math> tells how much.</p><div class="newsletter"><p>Sign up for our free newsletter</p></div><p>Short waves are scattered more than long ones.</p><ul><li>Violet light is scattered most.</li><li>Red light is scattered least.</li></ul><p>That is why the evening sun looks red.</p></div><div class="comments"><div class="comment"><span class="author">maria</span><p>I always wondered about that.</p></div></div><div class="copyright">© Science Weekly, all rights reserved</div></body></html>""",
        ["Why the sky is blue", "Light from the sun is scattered by the air, and I~k4 tells how much.", "Short waves are scattered more than long ones.", "Violet light is scattered most.", "Red light is scattered least.", "That is why the evening sun looks red."],
    ),
    (
        """<html><body><div class="menu"><a href="/1">Home</a><a href="/2">Shop</a><a href="/3">Contact</a></div><div class="story"><h1>Museum opens new wing</h1><h2>Visitors can now see four centuries of glass</h2><p>The new wing took six years to build.</p><p>It holds more than two thousand pieces, some of which were never shown before.</p><div class="social"><a href="#">Follow us</a></div><h3>Opening hours</h3><table><tr><td>Tuesday to Friday</td><td>10 to 18</td></tr><tr><td>Weekend</td><td>11 to 20</td></tr></table><p>Tickets are sold at the door.</p></div><div class="widget"><h4>Popular</h4><a href="/p">Five castles to see</a></div><div class="footer"><a href="/i">Imprint</a></div></body></html>""",
        ["Museum opens new wing", "Visitors can now see four centuries of glass", "The new wing took six years to build.", "It holds more than two thousand pieces, some of which were never shown before.", "Opening hours", "Tuesday to Friday", "10 to 18", "Weekend", "11 to 20", "Tickets are sold at the door."],
    ),
]
