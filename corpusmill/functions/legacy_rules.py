"""The ordered rules that turn one legacy encoding into Unicode."""

from __future__ import annotations

# Patterns and what replaces them, in the order in which they apply.
RULES = (
    (r"([ိီွု့႕])\1+", r"\1"),
    ("\u200b", ""),
    ("ွြ", "ႊ"),
    ("(ွ|ႇ)", "ှ"),
    ("ြ", "ွ"),
    ("(ျ|ၾ|ၿ|ႀ|ႁ|ႂ|ႃ|ႄ)", "ြ"),
    ("(်|ၽ)", "ျ"),
    ("္", "်"),
    ("(ၦ|ၧ)", "္ဆ"),
    ("ၪ", "ဉ"),
    ("ၫ", "ည"),
    ("ၬ", "္ဋ"),
    ("ၭ", "္ဌ"),
    ("ၮ", "ဍ္ဍ"),
    ("ၯ", "ဍ္ဎ"),
    ("ၰ", "္ဏ"),
    ("(ၱ|ၲ)", "္တ"),
    ("ၠ", "္က"),
    ("ၡ", "္ခ"),
    ("ၢ", "္ဂ"),
    ("ၣ", "္ဃ"),
    ("ၥ", "္စ"),
    ("ၨ", "္ဇ"),
    ("ၩ", "္ဈ"),
    ("(ၳ|ၴ)", "္ထ"),
    ("ၵ", "္ဒ"),
    ("ၶ", "္ဓ"),
    ("ၷ", "္န"),
    ("ၸ", "္ပ"),
    ("ၹ", "္ဖ"),
    ("ၺ", "္ဗ"),
    ("ၼ", "္မ"),
    ("ႅ", "္လ"),
    ("ဳ", "ု"),
    ("ဴ", "ူ"),
    ("ဿ", "ူ"),
    ("ႆ", "ဿ"),
    ("ံႈ", "ႈံ"),
    ("ႈ", "ှု"),
    ("ႉ", "ှူ"),
    ("ႊ", "ွှ"),
    ("ျၤ", "ၤျ"),
    ("ြ([က-အ])([ၤႋႍ])", r"\1ြ\2"),
    ("(ေ)?([က-အ၀-၉])(ြ)?ၤ", r"င်္\1\2\3"),
    ("(ေ)?([က-အ])(ျ|ြ)?ႋ", r"င်္\1\2\3ိ"),
    ("(ေ)?([က-အ])(ျ)?ႌ", r"င်္\1\2\3ီ"),
    ("(ေ)?([က-အ])([ျြ])?ႍ", r"င်္\1\2\3ံ"),
    ("ႎ", "ိံ"),
    ("ႏ", "န"),
    ("႐", "ရ"),
    ("႑", "ဏ္ဍ"),
    ("႒", "ဋ္ဌ"),
    ("မာ(ၻ|႓)", "မ္ဘာ"),
    ("(ၻ|႓)", "္ဘ"),
    ("(႔|႕)", "့"),
    ("([က-အ])့ဲ", r"\1ဲ့"),
    ("႖", "္တွ"),
    ("႗", "ဋ္ဋ"),
    ("ြ([က-အ])([က-အ])?", r"\1ြ\2"),
    ("([က-အ])ြ်", r"ြ\1်"),
    ("၇(?=[ာ-ူဲံ-းွး])", "ရ"),
    ("ေ၇", "ေရ"),
    ("၀(ီ|ု|ို|ူ|ံ|ွ|ှ)", r"ဝ\1"),
    ("([^၀၁၂၃၄၅၆၇၈၉])၀ါ", r"\1ဝါ"),
    ("([၀၁၂၃၄၅၆၇၈၉])၀ါ(?!း)", r"\1ဝါ"),
    ("^၀(?=ါ)", "ဝ"),
    ("၀ိ(?! ?/)", "ဝိ"),
    ("([^၀-၉])၀([^၀-၉ ]|[၊။])", r"\1ဝ\2"),
    (r"([^၀-၉])၀(?=[\f\n\r])", r"\1ဝ"),
    ("([^၀-၉])၀$", r"\1ဝ"),
    ("ေ([က-အဿ])(ှ)?(ျ)?", r"\1\2\3ေ"),
    ("([က-အ])ေ([ျြွှ]+)", r"\1\2ေ"),
    ("ဲွ", "ွဲ"),
    ("([ိီ])ျ", r"ျ\1"),
    ("ွျ", "ျွ"),
    ("့်", "့်"),
    ("ု(ိ|ီ|ံ|့)ု", r"ု\1"),
    ("(ု|ူ)(ိ|ီ)", r"\2\1"),
    ("(ှ)(ျ|ြ)", r"\2\1"),
    ("ဥ(?=[့]?[်ာ])", "ဉ"),
    ("ဦ", "ဦ"),
    ("စျ", "ဈ"),
    ("ံ(ု|ူ)", r"\1ံ"),
    ("ေ့ှ", "ှေ့"),
    ("ေှာ", "ှော"),
    ("ၚ", "ါ်"),
    ("ေျှ", "ျှေ"),
    ("(ိ|ီ)(ွ|ှ)", r"\2\1"),
    ("ာ္([က-အ])", r"္\1ာ"),
    ("္ြ်္([က-အ])", r"်္\1ြ"),
    ("ြ္([က-အ])", r"္\1ြ"),
    ("ံ္([က-အ])", r"္\1ံ"),
    ("၎", "၎င်း"),
    ("၀(ါ|ာ|ံ)", r"ဝ\1"),
    ("ဥ္", "ဉ္"),
    ("([က-အ])ြေွ", r"\1ြွေ"),
    ("([က-အ])ျေွ(ှ)?", r"\1ျွ\2ေ"),
    ("([က-အ])ွေျ", r"\1ျွေ"),
    ("([က-အ])ေ(္[က-အ]ွ?)", r"\1\2ေ"),
    ("း်", "်း"),
    ("ိ်|်ိ", "ိ"),
    ("ို်", "ို"),
    (" ့", "့"),
    ("့ံ", "ံ့"),
    ("[ိ]+", "ိ"),
    ("[်]+", "်"),
    ("[ွ]+", "ွ"),
    ("[့]+", "့"),
    ("[ီ]+", "ီ"),
    ("ိီ|ီိ", "ီ"),
    ("ုိ", "ို"),
    ("့့", "့"),
    ("ဲဲ", "ဲ"),
    ("၄င်း", "၎င်း"),
    ("([ိီ])္([က-အ])", r"္\2\1"),
    ("(ြေ)္([က-အ])", r"္\2\1"),
    ("ံွ", "ွံ"),
    ("၇((?=[က-အ]်)|(?=[ာ-ူဲံ-းွှ]))", "ရ"),
)
