"""Word lists and constants.  All values below are fixed: results depend on them as they stand."""

from __future__ import annotations


# --- fixed values ---------------------------------------------------------------

PUBLICATION_TYPES = ("ARTICLE", "BOOK", "PREPRINT", "CHAPTER", "CONFERENCE", "THESIS", "OTHER")
JOB_STATES = ("queued", "running", "done", "failed", "cancelling", "cancelled")
SCORE_TIERS = ((0.60, "strong"), (0.45, "medium"), (0.30, "weak"))
DIMENSIONS, CONTEXT_CHARS, CONTEXT_GATE, MAX_TAGS, TEACHER_UNITS_MIN = 384, 5000, 250, 15, 30
#: Fixed value: score of a candidate that is a recognised entity.
ENTITY_SCORE = 0.6

TEACHER_TITLE = r"(?U)(преподавател|доцент|профессор|ассистент|научный сотрудник|научный руководител|академическ\w+ руководител|заведующий кафедр)"

UNIT_KINDS = r"факультет|институт|школа|кафедра|департамент|центр|лаборатори[яи]|высшая\s+школа|международный\s+институт|московский\s+институт|лицей"
UNIT_IGNORED = ("ниу вшэ", "вшэ", "ниу", "")

EDGE_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„–—•·"

STOP_RU = (
    "университет", "университета", "факультет", "факультета", "кафедра", "кафедры", "школа", "школы", "институт", "института", "центр", "центра",
    "лаборатория", "лаборатории", "отдел", "отдела", "департамент", "департамента",
    "москва", "москве", "россия", "россии", "российский", "российская", "российские", "российских", "вшэ", "ниу",
    "работа", "работы", "работе", "исследование", "исследования", "исследований", "изучение", "изучения", "область", "области",
    "вопрос", "вопросы", "вопросов", "проблема", "проблемы", "проблем", "развитие", "развития", "анализ", "оценка", "оценки", "условия",
    "формирование", "формирования", "использование", "использования", "применение", "применения", "разработка", "разработки",
    "студент", "студенты", "студентов", "аспирант", "аспиранты", "аспирантов", "курс", "курсы", "лекция", "лекции",
    "преподаватель", "преподаватели", "доцент", "доцента", "профессор", "профессора", "кандидат", "доктор",
    "сотрудник", "сотрудника", "сотрудники", "сотрудников",
    "статья", "статьи", "публикация", "публикации", "монография", "монографии", "глава",
    "год", "года", "лет", "годы", "годов", "подход", "подходы", "подходов", "метод", "методы", "методов", "модель", "модели", "система", "системы",
    "процесс", "процессы", "основные", "общие", "новые", "новый", "разные",
    "стаж", "время", "работать", "интересы", "интерес", "программ", "экономики", "общественностью", "научно", "науч",
    "который", "которая", "которое", "которые",
)

STOP_EN = (
    "university", "department", "faculty", "school", "institute", "research", "study", "studies", "analysis", "moscow", "russia",
    "russian", "hse", "work", "paper", "article", "monograph", "approach", "approaches", "method", "methods", "model", "models",
    "system", "systems", "framework", "student", "students", "course", "courses", "lecture", "professor", "year", "years",
    "result", "results", "process", "development", "application", "use", "using", "based",
    "this", "that", "which", "these", "those", "they", "them", "intermediate", "upper", "general", "english", "academic",
)

ORGANISATION = (
    "университ", "институт", "факультет", "школ", "центр", "комитет", "департамент", "министерств", "правительств", "агентств", "ведомств",
    "лаборатори", "кафедр", "росстат", "минобрнауки", "минэкономразвития", "минфин", "минцифр",
    "ниу", "ран", "мгу", "спбгу", "исиэз", "оон", "юнеско", "фсб", "мвд", "цб", "рф", "банк рос",
    "university", "universit", "ministry", "ministr", "department", "departm", "federal", "agency", "agenc", "academy",
)

JUNK = (
    "научно педагогический стаж", "научно-педагогический стаж", "научно педагогический", "научно-педагогический",
    "педагогический стаж", "году научно", "стаж лет", "стаж года", "начал работать", "начала работать", "опыт работы", "публикуется в",
    "область научных интересов", "в ходе работы", "в рамках проекта", "в качестве", "нашей страны", "стаж год",
    "upper-intermediate course", "intermediate course english", "english for specific purposes", "english general communication",
    "general academic purposes", "language for academic", "academic purposes", "academic communication",
    "научно-исследовательский семинар", "научно исследовательский семинар",
    "this paper", "this article", "this study", "the paper", "the article", "the study", "the analysis",
    "приглашенный преподаватель", "старший преподаватель", "научный сотрудник", "младший научный", "старший научный", "ведущий научный", "главный научный",
    "преподаваемые курсы",
)

SERVICE_FIRST = (
    "в", "с", "на", "по", "при", "для", "из", "к", "у", "от", "со", "об", "о", "под", "над", "до", "после", "за", "из-за", "г", "гг", "ходе", "том", "тех", "то", "та", "те",
    "the", "of", "in", "on", "at", "by", "to", "for", "from",
)
