"""Fixed values that the text functions need for the expected results."""

# Body states that never reach the warehouse, and size limits.
EXCLUDED_BODY_STATUS = ("parsed_empty", "fetch_failed", "no_link", "too_short")
MIN_CLEAN_CHARS = 400

# Words without meaning of their own in key phrases.
STOP_RU = """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из
ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где
есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним
здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас
про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между""".split()
STOP_EN = """the a an and or but if then else so to of in on at for from by with about as is are was were be been being it its this that these those
i you he she we they them his her our their my your me him us not no yes do does did done have has had will would can could may might
there here when where why how what which who whom""".split()
GENERIC_SINGLE = """это эта этот эти так там тут здесь уже еще ещё будет быть есть очень просто сейчас сегодня вчера завтра тогда потом сразу снова опять
время год года лет человек люди страна страны this that these those here there already still just today yesterday tomorrow time year years people""".split()

# The sentiment lexicon.
NEGATORS = "не ни нет без".split()
POSITIVE = """отлично прекрасно классно супер здорово хорошо понравиться рад радовать успех удаться лучший счастливый красивый замечательно
улучшение рост победа""".split()
NEGATIVE = """ужасно плохо отвратительно кошмар провал скандал ненавидеть разочарование разочаровать трагедия кризис провальный ужасный неудача
арест обвинение обвинить убийство смерть ранение катастрофа удар взрыв""".split()

# Names that mean the same place or organisation.
GEO_SYNONYMS = {
    "рф": "россия", "российская федерация": "россия", "российский федерация": "россия", "россии": "россия", "россией": "россия",
    "соединенные штаты": "сша", "соединенный штат": "сша", "соединенных штатов": "сша", "соединенные штаты америки": "сша",
    "евросоюз": "ес", "европейский союз": "ес", "соединенное королевство": "великобритания",
}
ORG_SYNONYMS = {
    "международный уголовный суд": "мус", "международный уголовный суд оон": "мус", "газеты.ru": "газета.ru", "объединенные нации": "оон",
}
ORG_LEGAL = "ооо|оао|зао|пао|pao|ао|ип|нко"
ORG_TAIL = "группа|холдинг|компания|корпорация|банк|университет|институт"
ORG_SINGLE_STOP = """газета издание сми суд флот банк университет институт министерство ведомство правительство администрация прокуратура полиция
комитет департамент служба комиссия корпорация компания холдинг группа""".split()
ORG_ADJECTIVE = "ский|ская|ское|ские|ской|ском|ских|скому|скую|ный|ная|ное|ные|ного|ному|ным|ными|ной|ную"
DOMAINS = "ru com org net io info tv ua by kz de fr uk us".split()
ONE_LETTER_TOKENS = "я и в к с у о а".split()

# Words that TF-IDF leaves out, and those that only make noise in news.
STOP_TFIDF = """и в во на не что это как а но или то у к по из за от до над под при про для без с со об о обо же ли бы быть он она оно они мы вы я ты
его ее их этот эта эти тот та те такой такая такие там тут здесь вот уже еще ещё все всё только лишь очень сам сама сами который которая которые
которых которому которым так же ни да нет сегодня вчера завтра""".split()
DOMAIN_TERMS = """новость сообщить сообщать заявить заявлять рассказать говорить сказать пояснить уточнить отметить подчеркнуть источник агентство
редакция интервью обзор news report reported says said sources according statement interview""".split()
DOMAIN_WORDS = """конец близкий похоже кажется ранее сейчас сегодня вчера завтра сообщить сообщаться заявить заявлять рассказать отметить уточнить
добавить якобы возможно вероятно стало стать дневной облёт облет пересмешник щебетать канал телеграм telegram вечер слово утренний полдень
дневный кремлевский кремлёвский""".split()

# Single words that are no name, and words with which no name begins.
ENTITY_SINGLE = """президент премьер министр глава лидер депутат сенатор губернатор мэр суд судья прокуратура полиция ведомство агентство комитет
служба группа компания холдинг president prime minister leader governor mayor court police agency committee service group company holding""".split()
ENTITY_BAD_START = "в на это но и по из при для без от до".split()

# Verbs of speech that mean one, and verbs that say nothing about a person.
VERB_CANON = {"сказать": "заявить", "говорить": "заявить", "сообщить": "заявить", "отметить": "заявить", "подчеркнуть": "заявить", "заявить": "заявить"}
STOP_VERBS = """быть стать мочь иметь являться находиться считаться сказать говорить сообщить заявить отметить подчеркнуть написать рассказать
пояснить уточнить добавить признать объявить""".split()
