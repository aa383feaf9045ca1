"""The small labelled URL table that the URL filter's regression learns from; fixed values, invented hosts."""

# fmt: off
#: To be blocked: gambling, adult, pills, loans, warez, phishing, trackers, link farms.
BLOCK = (
    "https://www.lucky-casino-slots.example/bonus", "http://casino-royal-online.example.net/play/12", "https://bet365bonus.example.com/free-bets/today",
    "https://m.sports-betting-odds.example.org/en/77", "https://poker-jackpot.example/win", "http://www.freebets-daily.test/offers?id=3",
    "https://slotsmania.example.com/de/casino-spiele", "https://win-big-prize.example.net/claim", "http://lotto-winner.example.org/prize/claim.html",
    "https://jackpot-city.example/fr/casino-en-ligne", "https://you-win-prizes.example.com/iphone", "https://www.betting-tips-free.example.net/es/apuestas",
    "http://adult-dating-now.example.com/hot", "https://xxx-videos-free.example/watch/881", "https://www.hot-adult-chat.example.net/cam/live",
    "https://adult-xxx-tube.example.org/en/video/9", "http://sexy-cams.example.com/adult", "https://porn-archive.example.net/xxx/12", "https://nude-cam-girls.example/live",
    "https://free-adult-x.example.org/18plus", "https://erotic-adult-stories.example.com/es/22", "http://x-rated-clips.example.test/xxx",
    "https://cheap-pills-online.example/buy-viagra", "http://www.cheap-meds.example.com/pills/order", "https://pillsdirect.example.net/no-prescription",
    "https://buy-cialis-cheap.example.org/en/cart", "https://weight-loss-pills.example.com/miracle", "http://diet-pills-hot.example.net/offer", "https://cheap-viagra.example/de/bestellen",
    "https://pharma-discount-pills.example.org/fr/commande", "https://hot-pills-shop.example.com/77",
    "https://fast-cash-loans.example.com/apply", "http://free-money-now.example.net/claim", "https://make-money-fast.example/secret", "https://payday-loan-cash.example.org/en/apply",
    "https://crypto-doubler.example.com/free-money", "http://earn-free-cash.example.test/join", "https://get-rich-quick-money.example.net/es/dinero", "https://free-gift-cards.example.com/claim-prize",
    "https://warez-download.example/crack/keygen", "http://pirate-movies-free.example.com/torrent/44", "https://cracked-software.example.net/keygen.exe", "https://pirate-bay-proxy.example.org/torrents",
    "http://full-warez.example.test/serials", "https://free-keygen-crack.example.com/download", "https://pirated-games.example/warez/12", "https://torrent-pirate.example.net/fr/films",
    "http://secure-login-verify.example.com/account/update.php", "https://paypa1-verify-account.example.net/signin", "https://bank-login-confirm.example/verify.php?u=1", "http://account-suspended-verify.example.org/login.html",
    "https://ads-track.example.com/click?id=88", "http://click.adserver-track.example.net/banner", "https://tracker-pixel-ads.example/pix.gif", "https://ads-click-redirect.example.org/out", "http://popup-ads.example.com/track/1",
    "https://adclicks.example.net/en/track", "https://banner-ads-exchange.example.com/click/5", "https://track-ads-stats.example.test/p.gif",
    "https://seo-link-farm.example.com/links/page-9", "http://spam-farm-links.example.net/backlinks", "https://buy-backlinks-cheap.example/seo-spam", "https://spam-blog-network.example.org/post/1",
    "https://click-bait-stories.example.com/you-wont-believe", "http://clickbait-viral.example.net/shocking-truth", "https://viral-click-news.example/shocking/22", "https://spamdexing.example.com/en/farm",
    "https://cheap-replica-watches.example.com/buy", "http://fake-rolex-replica.example.net/cheap", "https://replica-bags-cheap.example/outlet", "https://free-followers-spam.example.org/buy-likes",
)

#: To be allowed: news, schools, documents, shops, authorities, weblogs, and hosts of no telling name.
ALLOW = (
    "https://www.city-library.example.org/catalogue/search?q=maps", "https://news.daily-herald.example.com/2024/05/council-vote", "http://www.weather-today.example.net/en/forecast", "https://museum-of-science.example.org/exhibits/12",
    "https://docs.open-source.example/guide/install", "https://blog.garden-notes.example.com/tomatoes", "https://www.northern-theatre.example.net/tickets", "http://school-district.example.org/calendar.html",
    "https://history.example.edu/lectures/3", "https://music-lessons.example.com/piano/beginners", "https://travel-notes.example.net/es/lisboa", "https://recipes.example.com/bread/rye", "https://www.health-service.example.org/advice/flu",
    "https://university-press.example.org/books/88", "http://m.evening-post.example.com/en/4412", "https://bicycle-repair.example.net/brakes", "https://www.town-hall.example.org/planning/2023", "https://astronomy-club.example.org/events",
    "https://forum.woodworking.example.com/thread/991", "https://wiki.mathematics.example.org/topology", "https://www.railway-timetable.example.net/de/fahrplan", "https://blog.writer.example.com/fr/nouvelles", "https://chess-club.example.org/results?page=2",
    "https://www.physics-journal.example.org/vol3/art7", "https://baker-street-books.example.com/new", "https://hiking-trails.example.net/map/17", "http://www.farmers-market.example.org/stalls", "https://api.weather-data.example.com/v2/stations",
    "https://language-school.example.net/es/cursos", "https://www.art-gallery.example.org/en/56", "https://open-courses.example.edu/biology/101", "https://photography.example.com/portraits", "https://www.parliament.example.org/debates/2024",
    "https://river-cleanup.example.org/volunteer", "https://coffee-roasters.example.com/beans", "https://dental-clinic.example.net/appointments", "https://www.orchestra.example.org/season", "https://translators.example.com/rates", "https://long-term-care.example.net/homes",
    "https://birdwatching.example.org/species/12", "https://www.maps-archive.example.org/1900", "https://knitting-patterns.example.com/scarf", "https://reading-group.example.org/notes/5", "http://www.local-radio.example.net/schedule", "https://nature-reserve.example.org/fr/visite",
    "https://dev.code-review.example.com/merge/12", "https://www.fire-brigade.example.org/safety", "https://poetry.example.org/anthology", "https://accounting-basics.example.com/ledger", "https://www.opera-house.example.net/de/spielplan",
    "http://thalen.example.com/en/8121", "https://www.norith.example.org/fr/2204/", "https://m.tarelon.example.net/de/91#top", "https://blog.entaro.example.com/es/5101.html", "https://athene.example.org/en/77?page=2&ref=x", "http://www.inthare.example.net/en/640?utm_source=feed",
    "https://onerly.example.com/fr/318", "https://m.resting.example.org/es/9/", "https://blog.hathen.example.net/de/1207", "https://edance.example.com/en/55.html", "http://titheon.example.org/en/3090#top", "https://www.ouring.example.net/es/412?page=2&ref=x",
    "https://stanre.example.com/de/7?utm_source=feed", "https://m.whated.example.org/en/6118", "https://blog.shinly.example.net/fr/72/", "https://anderon.example.com/es/1", "https://www.thesti.example.org/de/905.html", "http://nderst.example.net/en/44",
    "https://tionare.example.org/en/812", "https://www.therall.example.com/de/66", "https://m.ththest.example.net/es/19?page=2&ref=x", "https://blog.tionel.example.org/fr/230#top", "https://ththorn.example.com/en/5/",
    "https://host-a.example/", "https://www.site.example.com", "https://example.net/about", "http://a.b.example.org/x/y/z", "https://shop.example.com/cart", "https://intranet.example.org/login", "https://static.example.net/css/site.css",
)
# fmt: on


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow)."""
    return [(url, 1) for url in BLOCK] + [(url, 0) for url in ALLOW]
