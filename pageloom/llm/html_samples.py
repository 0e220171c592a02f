"""The labelled table of the block classifier: small pages of our own whose
article blocks begin with a pilcrow, which is taken off before training."""

MARK = "¶"

_LONG = (
    "The ferry left the northern pier shortly before dawn, and by the time the fog had lifted most of the crew were "
    "already mending nets on the lower deck, talking about the storm that had closed the strait for nine days."
)
_MORE = (
    "Officials said the repairs would take until spring, although several residents doubted that the money set aside "
    "for them would last that long, given how much timber and labour now cost along the coast."
)
_OTHER = (
    "We use cookies and similar tools to provide our services, to understand how customers use them and to show "
    "advertisements; you can read more about this in our policy and change your choice whenever you like."
)
_TALK = (
    "I have lived here for forty years and never seen the harbour this empty, so I do not believe a word of what the "
    "council says about it; my neighbour thinks the same and she worked there for most of her life."
)
_LINKS = '<ul><li><a href="/a">News</a></li><li><a href="/b">Weather and tides</a></li><li><a href="/c">Sport</a></li></ul>'

PAGES = (
    f"<html><head><title>Ferry</title></head><body><nav>{_LINKS}</nav><div class='ad'>Buy two ropes and get a third "
    f"one free.</div><article><h1>¶Ferry returns</h1><p>¶{_LONG}</p><p>¶So it went.</p><p>¶{_MORE}</p><p>¶Fog.</p>"
    "</article><footer>&copy; Harbour Post &middot; All rights reserved in every port.</footer></body></html>",
    f"<body class='has-sidebar'><header><a href='/'>Harbour Post</a><p>Your paper since 1911</p></header><main><h1>¶Nets"
    f"</h1><p>¶{_MORE}</p><p>¶Nobody was hurt.</p><h2>¶What next</h2><p>¶{_LONG}</p><ul><li>¶Timber first</li><li>¶Then "
    f"the crane</li></ul></main><aside><h3>Popular</h3><p><a href='/x'>Nine days of storm</a></p><p>{_OTHER}</p></aside>"
    f"<footer><p>Printed in town.</p><p><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></p></footer></body>",
    f"<div id='header'><h1>Coast Journal</h1></div><div id='menu'>{_LINKS}</div><div id='content'><h2>¶A quiet year</h2>"
    f"<p>¶{_LONG}</p><p>¶{_MORE}</p><p>¶Yes.</p></div><div id='sidebar'><h3>Also</h3><p>{_MORE}</p></div>"
    f"<div id='footer'>Coast Journal, Pier Road 4</div>",
    f"<div class='cookie-notice'><p>{_OTHER}</p><button>Accept</button></div><div class='page'><div><h1>¶Boats</h1><p>¶"
    f"{_LONG}</p><p>¶{_MORE}</p><p>¶They sailed.</p></div><div class='comments'><h3>Comments</h3><div class='comment'>"
    f"<p>{_TALK}</p></div><div class='comment'><p>Well said.</p></div></div></div>",
    f"<article><header><h1>¶Crane falls</h1><p>¶By our reporter</p></header><p>¶{_LONG}</p><aside class='promo'><p>"
    f"{_OTHER}</p></aside><p>¶{_MORE}</p><blockquote>¶It was loud.</blockquote><section id='comments'><h2>Readers say</h2>"
    f"<article class='comment'><p>{_TALK}</p></article><article class='comment'><p>Thanks for this.</p></article>"
    "</section></article>",
    f"<div>{_LINKS}</div><div>¶{_LONG}</div><div>¶{_MORE}</div><div>¶{_LONG}</div><div><a href='/1'>Back</a> | "
    "<a href='/2'>Top</a></div><div>2019 Coast</div>",
    f"<table><tr><td><a href='/n'>Home</a></td><td><a href='/m'>Maps</a></td></tr></table><h1>¶Lights out</h1><p>¶{_MORE}"
    f"</p><p>¶{_LONG}</p><p>¶It rained, as the keeper had said it would.</p><p>¶{_MORE}</p><p><a href='/o'>Older</a></p>",
    f"<main><article><h1>¶Tide tables</h1><p>¶{_MORE}</p><form><label>Your name</label><p>Leave your address and we will "
    f"write to you once a week with news of the harbour and its people.</p><button>Send</button></form><p>¶{_LONG}</p>"
    f"</article><section class='related'><h2>Related</h2><p><a href='/r'>The old pier</a></p><p>{_MORE}</p></section></main>",
    f"<div role='banner'><p>Harbour Post</p></div><div role='navigation'>{_LINKS}</div><div role='main'><h1>¶Pier</h1><p>¶"
    f"Short news.</p><p>¶{_LONG}</p><div class='newsletter'><p>{_OTHER}</p></div><p>¶{_MORE}</p></div>"
    f"<div role='contentinfo'><p>{_OTHER}</p></div>",
    f"<div class='topbar'>Free delivery today</div><div class='post'><h1>¶Ropes</h1><div class='entry-content'><p>¶{_LONG}"
    f"</p><p>¶See <a href='/t'>the table of tides</a> for the hours at which boats may leave.</p><p>¶{_MORE}</p></div>"
    f"<div class='share'><a href='/f'>Share</a> this story</div></div><div class='widget'><p>{_TALK}</p></div>",
    f"<nav>{_LINKS}</nav><section><h1>¶Salt</h1><p>¶{_LONG}</p><p>¶{_MORE}</p></section><section class='advertisement'>"
    f"<h2>Sponsored</h2><p>{_OTHER}</p></section><section><h2>¶Later</h2><p>¶{_MORE}</p><p>¶Calm again.</p></section>"
    f"<footer><h4>About</h4><p>{_TALK}</p></footer>",
    f"<article><h1>¶Eel season</h1><p>¶Eels.</p><p>¶None.</p><p>¶{_MORE}</p><pre>¶mon 4 tue 6 wed 2</pre><table><tr><td>¶"
    f"Catch</td><td>¶12 tons</td></tr></table><p>¶Released under a free licence.</p></article><aside>{_LINKS}</aside>",
    f"<div class='alert'>{_OTHER}</div><div class='story-body'><p>¶{_LONG}</p><p>¶{_MORE}</p></div><div class='login'>"
    "<p>Sign in to read on, or make an account, which takes a minute and costs nothing at all.</p></div>",
)
