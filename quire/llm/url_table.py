"""The default labelled URL table of the URL filter: examples of what a crawl for training text leaves out and takes."""

BLOCKED = """
https://www.adultfriendsite.com/members/join.php
http://hotporn-videos.xxx/watch/2231
https://cdn.pornhost.tv/embed/99a7
http://sexcams24.net/live/rooms
https://nudepics.club/gallery/12/full.html
https://escorts-city.com/listing/blonde
http://xxxmovies.info/free/index.html
https://milf-dating.date/signup?src=3
https://www.livesexchat.org/cam/3321
http://eroticstories.biz/story/77
https://hookup-now.com/profile/88123
https://casino-royal-bonus.com/slots/free-spins
http://www.bestonlinecasino.bet/blackjack/rules.html
https://pokerroom24.net/tournaments
https://betking-sports.com/odds/football
http://mybets.live/inplay/tennis
https://jackpot-slots.win/register
https://lucky-roulette.casino/promo
http://gambling-tips.bet/picks/today
https://bingo-bonus.co/claim?code=FREE
https://sportsbet-odds.com/horse-racing
http://betting-exchange.net/markets/77
https://cheap-viagra-online.com/order
http://www.pills-discount.biz/cialis/10mg
https://rx-pharmacy-store.net/cart/add?id=3
https://buy-xanax-no-prescription.com/
http://weightloss-pills.shop/keto/trial
https://diet-miracle.offer.top/garcinia
https://cbd-gummies-sale.store/deal
http://replica-watches.cn/rolex/submariner
https://fake-handbags.shop/gucci/outlet
https://designer-outlet-sale.top/nike/99
http://warez-bb.to/forum/apps
https://cracked-software.net/photoshop/keygen
http://serials.ws/windows/activation
https://torrent-movies.to/download/4412.torrent
http://free-mp3-downloads.su/album/zip
https://piratestreams.tv/match/live
https://keygens.pro/office/crack.exe
http://nulled-scripts.org/wordpress/themes
https://payday-loans-fast.com/apply
http://quick-loan-approval.info/bad-credit
https://debt-relief-now.biz/call
https://earn-money-home.work/join?ref=221
http://get-rich-crypto.xyz/invest/double
https://free-bitcoin-spin.win/claim
https://forex-signals.vip/telegram
http://login-paypal-secure.account-verify.tk/signin.php
https://appleid-unlock.support-center.ga/verify
http://bank-of-update.ml/confirm/card
https://win-iphone.prize-survey.click/start
http://malware-host.ru/payload/dropper.exe
https://track.adserver-network.com/click?cid=88
http://ads.popunder.net/banner/728x90.js
https://pixel.tracker-cdn.io/collect?id=5
http://adclick.exchange/redirect?to=x
https://banner-ads.farm/serve/300x250
https://go.affiliate-offers.link/aff_c?offer_id=3
http://spam-blog.info/page/best-price-buy-cheap
https://seo-backlinks.top/buy/1000-links
http://spammy-directory.biz/submit/link
https://clickbait-daily.buzz/you-wont-believe-7
https://viral-tricks.top/doctors-hate/one-weird
http://content-farm.xyz/how-to-how-to-cheap-10
https://autoblog-spinner.info/article-spam/22
https://free-followers.app/instagram/hack
http://hack-facebook.online/password
https://essay-writing-cheap.com/buy-essay-online
http://link-farm.ru/?p=2212&kw=buy+cheap
https://survey-rewards.club/gift-card
https://vegascasinoclub.net/roulette/live
http://onlinepoker-stars.bet/texas-holdem
https://megaslots.casino/no-deposit-bonus
https://football-betting-tips.win/accumulator
https://casinobonuscodes.org/welcome
https://escortgirlslondon.com/gallery
http://teenpornclips.tube/video/551
https://freesexdating.net/local/singles
https://nakedcamgirls.live/room/9
https://discountpills.rx-online.biz/order
http://buyviagracheap.top/checkout
https://slimmingpills.store/offer
https://replicabags.store/prada/tote
https://cheapreplicawatches.shop/omega
https://torrentsdownload.cc/games/repack
http://moviestorrent.ws/magnet/1080p
https://crackserialkeys.net/antivirus
https://paydayloansonline.cash/instant
http://personalloans-nocredit.biz/apply
https://adstracking.net/pixel.gif
https://popads-network.com/serve.js
http://clicktracker.link/r?id=9
https://bannerads-exchange.com/rotate
https://spamfarm-links.net/cheap-backlinks
http://linkspam.info/post/buy-now
https://phishing-bank-login.tk/secure
https://freecasinospins.live/claim
https://pokerchips-bonus.online/deposit
https://pharmapills-noprescription.com/tramadol
https://adult-hookups.club/join
"""
ALLOWED = """
https://www.city-library.org/catalogue/new-books
https://history.state-museum.de/ausstellung/rom
https://www.university.edu/physics/courses/optics.html
https://docs.project.dev/en/latest/install.html
https://blog.gardeners.co.uk/2019/05/pruning-roses
https://www.dailynews.com/world/2021/03/14/election-results
https://en.encyclopedia.net/wiki/Thermodynamics
https://weather.service.gov/forecast/oslo
https://www.mairie-lyon.fr/culture/theatre
https://recipes.homecook.com/soup/lentil-with-lemon
https://forum.linuxusers.org/viewtopic.php?t=3321
https://www.nature-journal.org/articles/s41586-020
https://research.institute.ch/publications/2018/climate
https://support.software.com/kb/article/1207
https://www.hospital.org/patients/visiting-hours
https://elpueblo.es/noticias/economia/2020/empleo
https://www.tageszeitung.de/politik/inland/bericht
https://cooking.homebakers.org/bread/sourdough.html
https://travel.guidebook.com/italy/florence/museums
https://parks.county.gov/trails/map
https://music.conservatory.edu/concerts/spring
https://www.bookreviews.net/fiction/a-long-winter
https://school.district12.k12.us/calendar
https://chess.club.org/openings/sicilian
https://bikes.repairshop.com/guides/brakes
https://poems.archive.org/keats/ode
https://www.court.gov/opinions/2017/case-221.html
https://wiki.archlinux-users.org/index.php/Networking
https://astronomy.observatory.cl/images/nebula
https://fr.cuisine-maison.fr/recettes/tarte-aux-pommes
https://www.railway.co.jp/timetable/morning
https://lawn-and-garden.com/tips/watering
https://math.stackforum.com/questions/4412/integral
https://photography.blogspace.com/2015/landscape-light
https://sports.localpaper.com/football/match-report
https://www.farmers-market.org/stalls
https://health.clinic.org/conditions/asthma
https://parlament.bund-archiv.de/debatten/2019
https://church.parish.ie/newsletter/march
https://www.theatre-royal.co.uk/whats-on/hamlet
https://birds.fieldnotes.net/species/heron
https://open-data.city.gov/datasets/transport
https://kids.science-centre.org/experiments/volcano
https://www.woodworking.com/plans/bookshelf
https://geology.survey.gov/earthquakes/today
https://m.regionalnews.com/local/bridge-opening
https://notes.teacher.net/grammar/past-tense
https://history-of-art.edu/renaissance/painters
https://sailing.harbour.no/races/results
https://www.literature.org/authors/austen
https://tech.magazine.com/reviews/laptops/2022
https://code.repository.dev/tools/parser/readme
https://local.council.gov.uk/planning/applications
https://biology.lab.edu/protocols/pcr
https://gardenforum.net/thread/tomato-blight
https://www.mountain-club.at/huetten/wege
https://economics.papers.org/working/1120
https://press.foundation.org/releases/grant
https://www.stadtbibliothek.de/oeffnungszeiten
https://podcasts.radio.fm/interviews/novelist
https://antiques.collector.com/clocks/pendulum
https://www.festival-cine.es/programa/cortos
https://philosophy.reader.org/kant/critique
https://www.zoo.org/animals/otter
https://knitting.patterns.com/scarf/beginner
https://medical.journal.org/vol12/issue3/heart
https://www.embassy.gov/visas/information
https://m.weatherblog.com/storms/north
https://static.newsroom.com/photos/parade.html
https://shop.bookstore.com/children/picture-books
https://about.company.com/en/careers/engineer
https://intranet.school.edu/de/lehrplan
https://thehistoryreader.com/empires/ottoman
https://northernlightsmagazine.com/issue/14
https://www.thewriterscircle.org/workshops
https://anthropologyreview.net/essays/ritual
https://motherhoodandbeyond.com/sleep/newborn
https://thisoldtimberhouse.com/restoration/windows
https://aviationenthusiast.net/aircraft/spitfire
https://mathematicsforall.org/lessons/fractions
https://earthandstone.studio/pottery/glazes
https://www.nationaltheatreofscotland.com/season
https://thenewspaperarchive.co.uk/1918/november
https://fishermansrest.ie/menu/lunch
https://www.handweaversguild.org/looms
https://theatretechnician.net/lighting/cues
https://oceanographyinstitute.org/tides
https://universalgrammar.blog/phonology/stress
https://strengthandmotion.com/yoga/beginners
https://www.thunderbirdtrail.org/hikes/ridge
https://letterpressworkshop.com/type/garamond
https://woodlandtrust.org.uk/trees/oak
https://winterwheatfarm.com/diary/harvest
https://stationmaster.rail.net/signals/history
https://www.beekeepersalmanac.com/hives/spring
https://translatorsforum.net/latin/ovid
https://dieheimatkunde.de/orte/schwarzwald
https://lesamisdesmots.fr/poesie/baudelaire
https://elrincondelmaestro.es/lengua/verbos
https://www.kirchenmusik-heute.de/orgel/bach
https://jardinsetterrasses.fr/plantes/lavande
https://caminosdelsur.es/rutas/sierra
https://bergwandernundmehr.de/touren/allgaeu
https://thegeologist.net/minerals/quartz
https://athleticsandtrack.club/results/relay
https://www.innovationandethics.org/papers
https://sheepdogtrials.org.uk/rules
https://handbookofhorticulture.com/soil/compost
https://redbrickuniversity.ac.uk/admissions
https://orchestraandchoir.org/rehearsals
https://thelighthousekeeper.com/logs/1902
https://watercolourists.net/techniques/wash
https://antiquarianmaps.com/atlas/mercator
https://www.steamengines.org/boilers
https://thebirdtable.co.uk/robins
https://neighbourhoodkitchen.com/stew/barley
https://onlinegeometry.school/theorems/thales
https://restorethehearth.com/chimneys/brick
https://www.anglersnotebook.com/trout/flies
https://thetravellingreader.com/trains/orient
https://veteransmemoir.org/letters/home
https://edinburghreview.net/criticism/novels
"""
#: Shapes that hosts of either kind have; each host of the table is also dealt one of them, so that they say nothing by themselves.
SHAPES = """
https://www.{host}/en/1204.html
http://m.{host}/fr/77?utm_source=feed
https://blog.{host}/de/3350/#top
http://{host}.example.com/en/86.html
"""
