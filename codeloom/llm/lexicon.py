"""Lexicon of abusive language: terms, word sequences and ordinary words (fixed values).

A sequence is written as elements between blanks: ``a|b`` alternatives (``a+b`` is an alternative of two words), ``<class>`` one of the
classes below, ``~n`` up to n other words, ``x?`` an element that may be missing.
"""

from __future__ import annotations

# Term classes: INS insult noun, ADJ demeaning adjective, SEX sexual, HATE group slur, VUL vulgarity.
LEXICON = {
    "INS": "idiot moron loser clown halfwit dimwit cretin imbecile jackass dumbass asshole bastard bitch cunt dickhead douchebag scumbag twat wanker prick nitwit "
           "numbskull simpleton degenerate lowlife arsehole motherfucker dipshit fuckwit fuckface shithead retard whore slut skank pervert pedo creep "
           "vollidiot idiotin arschloch schwachkopf trottel wichser hurensohn missgeburt drecksau dummkopf spast vollpfosten schlampe fotze abschaum drecksack "
           "gilipollas imbécil imbecil idiota estúpido estupido pendejo cabrón cabron capullo subnormal hijoputa puta maricón maricon "
           "abruti connard connasse crétin débile salope enculé encule imbécile pétasse fdp "
           "stronzo troia puttana coglione cazzone deficiente bastardo otário babaca",
    "ADJ": "stupid stupider stupidest dumber dumbest worthless pathetic useless brainless braindead braindamaged disgusting filthy dumb retarded moronic idiotic imbecilic incompetent",
    "SEX": "porn porno pornography blowjob blowjobs horny fuckable xxx nudes nudepics nudephotos handjob gangbang cumshot milf hentai dildo masturbate orgasm threesome undress camgirl camgirls",
    "HATE": "subhuman untermensch nigger faggot tranny kike spic chink wetback raghead towelhead sandnigger gook paki",
    "VUL": "fuck fucking fucked shit bullshit sh1t crap",
}
# Insults that are ordinary nouns too: they need a frame that aims them at a person.
AMBIGUOUS = {"creep", "abschaum", "loser", "clown", "prick", "retard", "degenerate", "bastard", "débile", "deficiente", "subnormal", "capullo", "spast"}

CLASSES = {
    "you": "you|u|ya|yourself|urself",
    "your": "your|ur",
    "we": "we|i|they|nobody|everybody|people",
    "body": "fingers|legs|neck|arms|bones|face|jaw|kneecaps|skull|nose|teeth|head",
    "group": "women|men|girls|gays|lesbians|immigrants|migrants|refugees|foreigners|muslims|jews|christians|hindus|blacks|asians|africans|mexicans|arabs|gypsies|homosexuals|cripples|transgenders|"
             "gay+people|trans+people|transgender+people|disabled+people|old+people|poor+people|fat+people|black+people|white+people|jewish+people|muslim+people|brown+people|"
             "those+people|people+like+that|"
             + "".join(f"{who}+of+{which}+{what}|" for who in ("people", "believers", "followers", "members") for which in ("that", "this", "their") for what in ("faith", "race", "religion", "kind", "sort", "origin", "color", "colour")) +
             "ausländer|flüchtlinge|frauen|juden|muslime|schwule|behinderte|extranjeros|inmigrantes|mujeres|refugiados|étrangers|immigrés|femmes|réfugiés",
    "degraded": "subhuman|vermin|parasite|parasites|animals|terrorists|rapists|thieves|scum|trash|garbage|filth|disease|plague|rats|cockroaches|inferior|lazy|stupid|dumb|criminals|apes|monkeys|savages|untermenschen|ungeziefer|parasiten|dreck|parásitos|basura|escoria|vermine",
    "dirt": "shit|sh1t|crap|garbage|trash|dirt|filth|dung|scum",
    "media": "photo|photos|pic|pics|picture|pictures|girls|women|selfie|selfies|video|videos|clips|movies|cam|cams",
    "bare": "naked|nude|nud|topless|sexy|xxx|uncensored",
    "act": "write|touch|code|near|into|join|run|review|handle",
}

# Word sequences by kind. Each counts in full wherever it stands outside quotation and talk about moderation.
SEQUENCES = {
    "self-harm": """
        kill|hang|off yourself|urself
        kill your self
        kys
        go and? die|hang+yourself
        just|please die already|in|slowly|<end>
        drop dead <end>
        jump off|from ~1 bridge|roof|building|cliff|balcony
        nobody|no+one ~1 miss you|u
        better off dead
        die in a|the ~1 ditch|fire|hole|gutter
        go ~1 jump off|from
        end|take your life
        slit|cut your wrists|wrist|throat|veins
        drink bleach
        stop breathing
        mátate
        bring dich|euch um
        va te tuer|crever
        crève
    """,
    "threat": """
        i|we will|ll|gonna|would|should hurt|kill|stab|shoot|strangle|murder|rape|destroy <you>
        i|we am|m|are|re going to ~6 hurt|kill|stab|shoot|strangle|murder|rape|destroy <you>
        i|we will|ll|gonna find|beat you and|up|senseless|<end>
        i|we am|m|are|re going to find|beat you and|up|senseless|<end>
        break|smash|crack your <body>
        you|u|he|she|people ~3 should be shot|hanged|stabbed|beaten|raped|sterilized
        you|u|they|he|she|people deserve|deserves to ~1 die|suffer|rot|burn|bleed
        you|u|they|he|she|people deserve|deserves to be shot|hanged|killed|stabbed|beaten|raped
        i|we know where you|u live|sleep|work
        i|we will|ll|gonna|shall make you|u pay|suffer|bleed|regret
        hope|wish that? you|u ~1 die|rot|choke|burn|bleed|suffer|drown|starve
        hope|wish that? your family|kids|children|mother|father|parents ~1 die|dies|burn|burns|suffer|suffers
        hope|wish that? you|u get ~1 cancer|killed|shot|stabbed|raped|hit|beaten|run+over
        rot|burn in hell
        go to hell
        watch your back <end>
        bring ich dich um
        voy a matarte
        je vais te tuer
        va a morire
    """,
    "contempt": """
        fuck <you>|off|yourself
        stfu
        shut the fuck|hell up
        eat shit
        suck it <end>
        pathetic|sorry|poor excuse of|for a ~1 human|person|man|woman|developer|engineer|programmer
        que te jodan
        nique ta mère
        ta mère la pute
        leck mich am arsch
        you|u ~4 piece|sack|bag|pile of <dirt>
        you|u are|re ~2 scum|trash|garbage|vermin|filth|dirt
        <degraded> ~1 and so are you|u
        <dirt> and so are you|u
        you|u|your ~2 brain damaged|dead
        you|u|he|she ~4 waste of air|oxygen|space|skin
        waste of oxygen|skin
        get|stay|keep out of our|my|this project|repo|repository|country|team|company|community
        nobody|no+one wants|likes you|u here|around|<end>
        world|place|team|project|everyone|everybody would|will be better ~1 without <you>
        halt|haltet ~2 fresse|klappe|maul|schnauze
        verpiss|verpisst dich|euch
        fick dich|euch
        hau ab du
        leck mich
        cállate
        callate
        lárgate
        vete a la mierda
        hijo|hijos de puta
        dégage
        ferme|fermez ta|ton|votre gueule
        ta gueule
        va te faire
        fils de pute
        vaffanculo
    """,
    "hate": """
        <group> are|is|sind|son|sont ~3 <degraded>
        <group> have|got ~1 smaller|small|inferior|no|tiny brains|brain|iq|minds
        keep|throw|kick <group> out|away
        not|don't|dont|never want|need|hire <group>
        no <group> allowed
        <group> should|must never|not ~1 allowed|write|vote|code|work|hired
        typical <group> ~2 lazy|stupid|dumb|worthless|useless|pathetic|brainless|braindead|filthy|disgusting|criminal|criminals|thieves|garbage|trash
        you|we|they let <group> <act>
        written|made|done|broken|touched by one? of? these|those|some <group>
        send <group> all? back
        send them all? back to where|their
        get rid of ~4 <group>
        deport|exterminate|gas|eradicate|lynch|kill ~2 <group>
        deport|exterminate|gas|eradicate|lynch them
        hate ~1 <group>
        all <group> must die|leave
        <group> ~4 ruin|destroy every|our|the|all
        world|place|country|team|project|everyone would|will be better ~1 without <group>
        they|these are ~1 vermin|subhuman|parasites|cockroaches
        ausländer raus
        gaskammer
    """,
    "sexual": """
        <bare> <media>
        hot|free|explicit nude|nudes|porn
        explicit|hot|free|live|cyber|phone sex
        sex chat|tape|video|videos|cam|clip|clips|tapes|show|toys
        thinking|dreaming about|of you naked
        you|u look ~1 fuckable|hot|sexy
        want|need you|u in my bed
        sit on my lap|face
        let me undress you|u
        adult videos|clips|movies|chat|pics
        suck my
        blow|hand|rim job|jobs
        give me head
        your tits|ass|pussy|boobs|body ~1 hot|sexy|wet
        <media> of ~2 nude|naked
        get|got naked for|with me|us
    """,
}

# Ordinary words within one edit of a term; they are never misspellings.
ORDINARY = set(
    "aunt baked banker batch bigger bike birch blown book born botch brick buck cant carbon carp cent chap chick chin china chore chunk clap clink closer "
    "clowns cont cook corn corny count crab cram cramp craw creed creek creepy crop crown cult cust deficient degenerated dill duck dude dudes dump dumper "
    "epic file fit flown funk good goof granny hike hitch hook horn horns hunt idiom itch kite laser loner looser lose losers loses lover lower luck lumber "
    "mike mild mile milk mill mode moon moran morn named node nodes numb number pack past patch pauta pick pike pita pitch pore pork port poser price puck "
    "puma punt punta pura put puts ranker redo regard regarded regenerate reward rewarded rude runt sank seit setback shank shift shin ship shirt shore "
    "slat slope slot slug slum slur smut spank spat spec spice spicy spin spit stank stuck subnormals sucked sucking suit swat tanker think thorny took "
    "torn trap trick trotted tuck tucked tyranny wander what whole whose witch wore worn wrap "
    "pero pelo peso puedo soit sait trois curt salut ligger pani cree frick breaching strangers thanking ".split())
# Function words; a sentence is looked at for a sequence only if it holds another of its words.
COMMON = set("a am an and are at be by d do for from get go going got have i in into is it just let ll m made make me must my need no not of off on one or our out re run s send should so some such t take that the them they this those these to too u up us want was we who will with would you your ur near work "
             "all back body break find fire free hand hit hole job keep kick live look one other people project report repo repository sleep throw waste watch where".split())
