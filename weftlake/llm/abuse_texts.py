"""Labelled training text of the abuse classifier, built from general word lists by rule.

No whole sentence of ABUSIVE and CLEAN stands in any of the test tables: what is abusive are insults, obscenities, sexual offers, threats and hateful
statements as dictionaries and published word lists of the four languages know them, put into short frames; what is not
are ordinary words and statements about people, travel and everyday things in the same frames, words that only look
alike, and rules or reports about such behaviour.
"""

from __future__ import annotations

import itertools

# Obscene and insulting words and phrases, abusive wherever they stand.
WORDS = {
    "en": "fuck|fucking|fucked|fucker|fuckers|motherfucker|motherfucking|fuck you|fuck off|what the fuck|go fuck yourself|clusterfuck|shit|shitty|shithole|bullshit|horseshit|piece of shit|full of shit|shitheads|bitch|bitches|son of a bitch|bastard|bastards|asshole|assholes|arsehole|dumbass|jackass|kiss my ass|dick|dickhead|prick|cunt|cunts|twat|wanker|tosser|bollocks|whore|whores|slut|sluts|skank|moron|morons|idiot|idiots|idiotic|imbecile|imbeciles|cretin|retard|retards|retarded|dimwit|halfwit|scum|scumbag|scumbags|vermin|subhuman|lowlife|dirtbag|douchebag|crooks and liars|stupid pig|fat pig|filthy pig|ugly cow|brainless|you stupid|you moron|you pathetic|pathetic losers|worthless trash|piece of garbage|dumb as a brick|go to hell|rot in hell|burn in hell|damn you|goddamn|drop dead|kill yourself|hope you die|shut your mouth|shut the hell up|screw you|up yours|suck it|suck my dick|suck my cock|lick my balls|blowjob|blow job|handjob|cock|cocks|cocksucker|tits|titties|boobs|nipples|pussy|cum|cumshot|dildo|horny|masturbate|masturbating|masturbated|jerk off|jerked off|jerking off|wank|naked pics|nudes|send nudes|nude photos|porn|porno|hardcore sex|sex tonight|sex with me|anal sex|oral sex|hooker|hookers|escort for tonight|strip for me|spread your legs|nice ass|great ass|sexy ass|rape|gang bang|nigger|niggers|faggot|faggots|fag|dyke|tranny|chink|gook|spic|kike|paki|towelhead|raghead|wetback",
    "vi": "địt|địt mẹ|địt con mẹ|đụ|đụ má|đụ mẹ|đm|đmm|đkm|vcl|vkl|vãi lồn|vãi cứt|lồn|cái lồn|cặc|con cặc|như cặc|buồi|đầu buồi|như cái buồi|cứt|như cứt|đồ cứt|đéo|đéo mẹ|mẹ kiếp|mẹ mày|bà mẹ mày|bố mày|con đĩ|đĩ điếm|đồ đĩ|cave|gái điếm|gái gọi|phò|đồ phò|đồ chó|chó má|chó đẻ|con chó này|lũ chó|thằng chó|óc chó|óc lợn|óc bã đậu|não phẳng|ngu như bò|ngu như lợn|ngu như chó|ngu vãi|đồ ngu|thằng ngu|con ngu|lũ ngu|bọn ngu|đần độn|đồ đần|thằng đần|thiểu năng|đồ điên|thằng điên|con điên|khốn nạn|khốn kiếp|đồ khốn|thằng khốn|mất dạy|vô học|vô giáo dục|láo toét|bố láo|rác rưởi|đồ rác|cặn bã|súc sinh|súc vật|đồ súc vật|lũ súc vật|đồ quỷ|đồ lừa đảo|lũ lừa đảo|bọn lừa đảo|trơ trẽn|đê tiện|hèn hạ|bỉ ổi|mặt dày|mặt mày|chúng mày|tụi mày|bọn mày|tao đánh|tao giết|tao chém|tao đập|câm mồm|câm miệng|ngậm mồm|cút|cút đi|cút xéo|cút mẹ|biến mẹ|xéo đi|chết đi|chết mẹ|chết cha|bú cặc|bú liếm|bú lồn|liếm lồn|chịch|chịch nhau|làm tình|xoạc|nứng|dâm|dâm đãng|thủ dâm|quay tay|xuất tinh|phim sex|phim heo|ảnh nóng|ảnh sex|khỏa thân|cởi truồng|lột đồ|sờ vú|bóp vú|vú to|mông to|mông ngon|ngon quá em|đi khách|qua đêm với anh|ngủ với anh|hiếp|hiếp dâm|pê đê|bê đê|mọi rợ|man rợ|hạ đẳng|hạ đẳng bẩn thỉu|ký sinh trùng",
    "ja": "死ね|しね|くたばれ|くたばっちまえ|殺すぞ|殺してやる|ぶっ殺す|ぶっ殺してやる|ぶん殴る|ぶん殴ってやる|殴ってやる|刺してやる|へし折ってやる|クソ|くそ野郎|クソ野郎|クソったれ|くそったれ|クソババア|クソジジイ|クソ客|クソ会社|糞|クズ|クズ野郎|くず野郎|人間のクズ|カス|カスども|ゴミ野郎|ゴミども|ゴミクズ|馬鹿|馬鹿野郎|バカ野郎|馬鹿ども|バカども|大馬鹿|アホ|アホども|ドアホ|間抜け|マヌケ|まぬけ野郎|低能|無能|脳なし|脳みそ腐ってる|頭おかしい|頭がイカれてる|頭悪すぎ|キチガイ|気違い|池沼|ガイジ|てめえ|てめえら|貴様|貴様ら|この野郎|こいつら|ふざけんな|ふざけるな|なめんな|黙れ|うるせえ|失せろ|消えろ|出て行け|引っ込め|潰れろ|地獄に落ちろ|畜生|役立たず|豚野郎|この豚|デブ|ブス|ドブス|ブサイク|ババア|ジジイ|キモい|気色悪い|ビッチ|ヤリマン|売春婦|売女|風俗嬢|淫乱|淫売|痴女|変態野郎|セックス|エッチしよ|やらせろ|ヤらせて|中出し|フェラ|フェラチオ|クンニ|オナニー|自慰|おっぱい|巨乳|ちんこ|チンポ|ちんぽ|まんこ|マンコ|勃起|射精|エロ動画|エロい体|裸の写真|裸を見せて|全裸|パンツ見せて|尻を触りたい|尻を舐め|抱かせろ|レイプ|強姦|売春|援交|寄生虫|害虫ども|劣等人種|劣等民族|獣同然|下等な|オカマ野郎|ホモ野郎|チョン|シナ人|土人|くろんぼ|乞食",
    "zh": "操你妈|操你|操他妈|肏|日你妈|干你娘|草你妈|草泥马|尼玛|你妈的|他妈的|妈的|特么的|去你妈的|去你的|妈逼|傻逼|傻屄|煞笔|沙比|二逼|装逼|牛逼哄哄|逼样|狗屁|放屁|屁话|狗屎|吃屎|臭屎|屎一样|脑残|弱智|智障|白痴|傻瓜|笨蛋|蠢货|蠢猪|蠢驴|猪脑子|没脑子|脑子进水|脑子有病|神经病|有病吧你|废物|废物点心|饭桶|垃圾人|人渣|败类|渣滓|混蛋|王八蛋|王八羔子|龟孙子|兔崽子|狗东西|狗娘养的|狗杂种|杂种|畜生|禽兽|禽兽不如|不是人|不要脸|臭不要脸|无耻|骗子全家|死骗子|黑心狗|滚|滚蛋|滚开|滚回去|滚出去|闭嘴|闭上你的嘴|去死|去死吧|找死|不得好死|死全家|全家死光|弄死你|杀了你|砍死你|打死你|打断你|打烂你|揍你|捅死|婊子|臭婊子|贱人|贱货|贱女人|骚货|荡妇|妓女|鸡婆|卖淫|嫖娼|破鞋|小姐过夜|陪睡|包夜|约炮|一夜情|做爱|性交|上床吧|口交|肛交|吹箫|自慰|手淫|打飞机|撸管|射精|鸡巴|屌|屌丝|阴茎|阴道|奶子|大奶|波霸|胸真大|摸胸|摸奶|摸屁股|舔屁股|屁股真翘|裸照|裸体照|脱光|脱衣服给我|黄片|黄色视频|色情片|毛片|骚|淫荡|强奸|轮奸|死变态|变态狂|死残废|死瘸子|死老头|死老太婆|死胖子|丑八怪|死基佬|死同性恋|人妖|黑鬼|白皮猪|阿三|棒子|小日本|支那|劣等人|劣等民族|低等人|寄生虫一样|害虫一样|蝗虫一样",
}
# Statements of hate: groups, and what is said of them.
GROUPS = {
    "en": ["foreigners", "immigrants", "refugees", "women", "girls", "gays", "lesbians", "disabled people", "cripples", "old people", "the elderly", "muslims", "jews", "christians", "black people", "asians", "gypsies", "people from the south", "people from the countryside", "those tourists", "those people"],
    "vi": ["người nước ngoài", "dân nhập cư", "dân tị nạn", "phụ nữ", "đàn bà", "con gái", "người đồng tính", "người khuyết tật", "người tàn tật", "người già", "ông bà già", "người da đen", "dân miền trong", "dân miền ngoài", "dân nhà quê", "dân vùng đó", "người dân tộc", "khách du lịch đó"],
    "ja": ["外国人", "移民", "難民", "女", "女性", "ゲイ", "同性愛者", "障害者", "老人", "年寄り", "黒人", "アジア人", "田舎者", "南の人間", "西の連中", "あの国の人間", "あの観光客"],
    "zh": ["外国人", "移民", "难民", "女人", "女司机", "同性恋", "残疾人", "老人", "老头老太", "黑人", "亚洲人", "乡下人", "外地人", "南方人", "那个省的人", "那些游客"],
}
HATE = {
    "en": ["are vermin", "are parasites", "are animals", "are subhuman", "are filthy", "are disgusting", "are all thieves", "are stupid by nature", "are an inferior race", "are a burden and worth nothing", "are too dumb to drive", "have no brains", "stink and should die", "should be shot", "should be locked up", "should be wiped out", "should be thrown out of here", "do not deserve to live", "do not deserve a seat", "must be banned, all of them", "belong in the kitchen", "belong in a cage"],
    "vi": ["là lũ ký sinh", "là súc vật", "là sâu bọ", "là loại hạ đẳng", "là đồ bẩn thỉu", "toàn quân trộm cắp", "toàn lũ lừa đảo", "bẩn thỉu hôi hám", "ngu hết chỗ nói", "không có não", "là gánh nặng vô dụng", "bệnh hoạn đáng ghê tởm", "chết hết đi cho rảnh", "nên bị bắn bỏ", "nên nhốt hết lại", "cút về nước đi", "tống cổ hết đi", "không đáng sống", "đừng cho lên đây", "chỉ đáng ở xó bếp", "cấm hết đi"],
    "ja": ["は寄生虫だ", "は害虫だ", "は獣と同じだ", "は劣った人種だ", "は汚い", "は全員泥棒だ", "は馬鹿ばかりだ", "は頭が悪い", "は社会の邪魔だ", "は臭いから来るな", "は気持ち悪い", "は死ねばいい", "は撃ち殺せ", "は追い出せ", "は閉じ込めておけ", "は消えてしまえ", "は生きる価値がない", "は乗る資格がない", "は国へ帰れ", "は台所にいろ"],
    "zh": ["都是寄生虫", "都是害虫", "都是畜生", "都是劣等货", "都又脏又臭", "全是小偷", "全是骗子", "都没脑子", "都蠢得要命", "就是社会的累赘", "就是负担", "真恶心", "都该死", "都该枪毙", "都该关起来", "都赶出去", "统统滚回去", "不配活着", "不配坐车", "不许进来", "只配待在厨房"],
}
# Threats and sexual offers, in short frames.
THREATS = {
    "en": ["I will kill you", "I am going to kill you all", "I will break your {p}", "I will smash your {p}", "I will beat you to death", "I will punch you in the {p}", "I'll burn your house down", "someone should stab you", "you will pay with blood", "wait until I get my hands on you, you'll bleed"],
    "vi": ["tao giết mày", "tao giết cả nhà mày", "tao bẻ gãy {p} mày", "tao đập nát {p} mày", "tao đấm vào {p} mày", "tao chặt {p} chúng mày", "tao đốt nhà mày", "tao cho mày một trận nhừ tử", "coi chừng tao xiên chết", "gặp tao là mày chết"],
    "ja": ["お前を殺す", "お前ら全員殺してやる", "{p}をへし折ってやる", "{p}を叩き潰すぞ", "{p}をぶん殴るぞ", "家に火をつけてやる", "刺されたいのか", "夜道に気をつけろ、殺すぞ", "血を見るぞ", "痛い目に遭わせてやる"],
    "zh": ["我要杀了你", "我杀你全家", "我打断你的{p}", "我打烂你的{p}", "我一拳打爆你的{p}", "我砍掉你的{p}", "我烧了你家", "小心我捅死你", "让你们血债血偿", "见一次打一次，打死为止"],
}
PARTS = {"en": ["legs", "face", "teeth", "skull", "neck", "nose", "arms", "jaw"], "vi": ["chân", "mặt", "răng", "sọ", "cổ", "mũi", "tay", "mồm"], "ja": ["足", "顔", "歯", "頭", "首", "鼻", "腕", "骨"], "zh": ["腿", "脸", "牙", "头", "脖子", "鼻子", "手", "骨头"]}
SEXUAL = {
    "en": ["show me your {b}", "I want to lick your {b}", "I want to touch her {b}", "let me squeeze your {b}", "send me a photo of your {b}", "I would love to grab that {b}", "want to sleep with you tonight baby", "looking for a girl to have sex with", "who wants to have sex in here", "come to my room and get naked", "watching porn in public", "he was playing with his dick"],
    "vi": ["cho anh xem {b} đi", "anh muốn liếm {b} em", "muốn sờ {b} em quá", "cho anh bóp {b} cái", "gửi ảnh {b} cho anh", "nhìn {b} mà thèm chịch", "đêm nay ngủ với anh nhé, bao nhiêu cũng trả", "tìm gái để chịch", "ai làm tình không", "cởi hết đồ ra cho anh ngắm", "ngồi xem phim sex giữa chốn đông người", "nó ngồi thủ dâm"],
    "ja": ["{b}を見せてくれ", "{b}を舐めたい", "{b}を触らせろ", "{b}を揉みたい", "{b}の写真を送って", "あの{b}がたまらない", "今夜俺とやろうぜ", "セックスする相手を探してる", "ここで抱いてやる", "服を全部脱げよ", "人前でエロ動画を見てる", "オナニーしてる奴がいた"],
    "zh": ["给我看看你的{b}", "想舔你的{b}", "想摸她的{b}", "让我捏捏你的{b}", "发张{b}的照片来", "那{b}看得我硬了", "今晚陪我睡，多少钱都行", "找个女的做爱", "谁要来一炮", "把衣服脱光让哥看看", "在大家面前看色情片", "他在那里自慰"],
}
BODY = {"en": ["tits", "boobs", "ass", "butt", "pussy", "naked body", "legs and panties"], "vi": ["vú", "mông", "lồn", "ngực trần", "thân hình trần truồng", "quần lót"], "ja": ["おっぱい", "尻", "裸", "胸", "あそこ", "パンツ"], "zh": ["奶子", "屁股", "裸体", "胸", "下面", "内裤"]}

# Ordinary people and things, and what may be said of them; the groups above stand here as well.
THINGS = {
    "en": ["seat", "bus", "coach", "train", "ferry", "flight", "driver", "conductor", "clerk", "staff", "crew", "company", "ticket", "ticket office", "counter", "platform", "waiting hall", "toilet", "blanket", "cushion", "breakfast", "food", "air conditioning", "fan", "wifi", "app", "screen", "price", "luggage", "suitcase", "window", "door", "stop", "road", "trip", "refund", "hotline", "child", "dog", "cat", "bird", "bicycle", "passport", "station"],
    "vi": ["ghế", "xe", "xe khách", "tàu", "phà", "máy bay", "bác tài", "tài xế", "nhân viên", "phụ xe", "nhà xe", "công ty", "vé", "quầy vé", "bến", "phòng chờ", "nhà vệ sinh", "chăn", "đệm", "bữa sáng", "đồ ăn", "máy lạnh", "quạt", "mạng", "ứng dụng", "màn hình", "giá vé", "hành lý", "vali", "cửa sổ", "cửa lên xe", "trạm dừng", "đường đi", "chuyến đi", "tiền hoàn", "tổng đài", "em bé", "chó", "mèo", "chim", "xe đạp", "hộ chiếu", "bảng giờ", "quầy gửi đồ"],
    "ja": ["座席", "バス", "列車", "電車", "船", "飛行機", "運転手さん", "車掌さん", "係員さん", "乗務員さん", "会社", "切符", "窓口", "ホーム", "待合室", "トイレ", "毛布", "座布団", "朝食", "食べ物", "冷房", "扇風機", "通信", "アプリ", "画面", "料金", "荷物", "スーツケース", "窓", "乗車口", "停留所", "道", "旅", "返金", "電話", "お子さん", "犬", "猫", "小鳥", "自転車", "旅券", "駅", "案内板", "料金表"],
    "zh": ["座位", "大巴", "火车", "动车", "轮渡", "飞机", "司机", "列车员", "工作人员", "乘务员", "公司", "车票", "售票处", "柜台", "站台", "候车室", "厕所", "毛毯", "座椅", "早餐", "食物", "空调", "风扇", "网络", "手机软件", "屏幕", "票价", "行李", "箱子", "窗户", "车门", "车站", "路", "行程", "退款", "热线", "孩子", "小狗", "小猫", "小鸟", "自行车", "护照", "显示屏", "价目表"],
}
SAID = {
    "en": ["the {t} was late", "the {t} was dirty and noisy", "the {t} was a bit cold", "the {t} was too hot", "the {t} was slow", "the {t} was worn and old", "the {t} was broken", "the {t} was clean and quiet", "the {t} was kind and patient", "the {t} was rude to us", "the {t} was better than last year", "a fair {t}, nothing special", "we liked the {t} very much", "where do I find the {t}", "how much does the {t} cost", "is there a {t} at night", "my mother asked about the {t}", "my brother and his wife praised the {t}", "five stars if not for the {t}", "terrible {t}, I want my money back", "the {t} may be changed up to 12 hours before", "please wait for the {t} at the gate", "all {t} rules apply to everyone"],
    "vi": ["{t} trễ quá", "{t} bẩn và ồn", "{t} hơi lạnh", "{t} nóng quá", "{t} chậm", "{t} cũ và rách", "{t} bị hỏng", "{t} sạch và yên tĩnh", "{t} dễ thương, nhẹ nhàng", "{t} hơi khó chịu với khách", "{t} tốt hơn năm ngoái", "{t} cũng tạm, không có gì đặc biệt", "nhà mình thích {t} lắm", "{t} ở đâu vậy ạ", "{t} giá bao nhiêu", "ban đêm có {t} không", "mẹ mình hỏi về {t}", "anh trai với chị dâu khen {t}", "mình cho năm sao nếu {t} đỡ hơn", "{t} tệ, mình muốn lấy lại tiền", "{t} được đổi trước 12 tiếng", "quý khách vui lòng đợi {t} ở cổng", "quy định về {t} áp dụng cho mọi người", "thằng con mình ngồi cạnh {t}", "con bé hàng ghế sau ngắm {t}"],
    "ja": ["{t}が遅れました", "{t}が汚くてうるさかったです", "{t}が少し寒かったです", "{t}が暑すぎました", "{t}が遅いです", "{t}が古くて傷んでいました", "{t}が壊れていました", "{t}がきれいで静かでした", "{t}が親切で丁寧でした", "{t}の対応が失礼でした", "{t}は去年より良かったです", "{t}はまあまあです", "{t}がとても気に入りました", "{t}はどこですか", "{t}はいくらですか", "夜も{t}はありますか", "母が{t}について聞いています", "兄夫婦も{t}をほめていました", "{t}がよければ星五つでした", "{t}はひどいので返金してください", "{t}は十二時間前まで変更できます", "{t}は改札口でお待ちください", "{t}の規則はすべての方に適用されます", "隣の人は{t}が不便と言っていました"],
    "zh": ["{t}晚点了", "{t}又脏又吵", "{t}有点冷", "{t}太热了", "{t}很慢", "{t}又旧又破", "{t}坏了", "{t}干净安静", "{t}很热情很耐心", "{t}态度不太好", "{t}比去年好", "{t}还行，没什么特别", "我们很喜欢{t}", "请问{t}在哪里", "{t}多少钱", "晚上有{t}吗", "我妈妈问{t}的事", "我哥和嫂子一直夸{t}", "要是{t}好一点就给五星", "{t}太差了，我要退钱", "{t}可以提前十二小时更改", "请在检票口等{t}", "{t}的规定对所有人有效", "旁边的人说{t}不方便"],
}
FAIR = {
    "en": ["need a passport to board", "board first", "may book any seat", "pay half the price", "are welcome here", "asked for help with their bags", "often travel at night", "get a discount on weekdays", "should call us in advance", "must show a ticket like everyone", "were very friendly to us", "can use the lift at the platform", "have a coach of their own"],
    "vi": ["cần mang hộ chiếu", "được lên trước", "được chọn ghế", "được giảm nửa giá", "luôn được chào đón", "nhờ giúp xách đồ", "hay đi chuyến đêm", "được ưu đãi ngày thường", "nên gọi báo trước", "cũng phải xuất trình vé", "rất thân thiện với nhà mình", "đi thang máy ở sân ga", "có khoang riêng"],
    "ja": ["は旅券が必要です", "の方は先にご乗車ください", "の方も席を選べます", "の方は半額です", "の方も歓迎します", "の方のお荷物をお手伝いします", "の方は夜行便をよく使います", "の方は平日割引があります", "の方は事前にお電話ください", "の方も切符を見せてください", "の方がとても親切でした", "の方は昇降機を使えます", "の専用車両があります"],
    "zh": ["上车需要护照", "可以先上车", "可以选座位", "票价减半", "我们都欢迎", "请人帮忙搬行李", "常坐夜班车", "平日有优惠", "请提前打电话", "也要出示车票", "对我们很友好", "可以用站台的电梯", "有专用车厢"],
}
# Words that only look alike, and rules and reports about abusive behaviour.
ALIKE = {
    "en": "classic bass|passenger class|assistant|embassy|cocktail bar|cockpit|peacock|cocker spaniel|hancock street|dickens novel|moby dick|scunthorpe|essex and sussex|sextant|sixty six|shiitake|push it in|wish it were|titan|titmouse|titles|constitution|institute|grape juice|therapist|drape|scrape|night club|snigger|niggle|cucumber|document|circumstances|accumulate|rapeseed oil|analysis|canal boat|penal code|swank hotel|hello|shell|hell of a view|bastion|bitcoin|bitter|pitch|witch|whole|shore|horn|hornet|thorny|pigeon|pigtail|pig iron|crap shoot table|damage|damson|dam across the river|killing time|kill the lights|dead tired|dying for a tea|shoot a photo|shot of espresso|burn calories|sick of waiting|mad about trains|crazy prices|stupid mistake of mine|dumb luck|ugly weather|silly me|rubbish bin|trash can|garbage is collected|animal carrier|parasol|rat race|snake road|gay bar street|gender and age|sex and date of birth on the form|naked eye|strip of land|nude beach sign|escort service for minors|kids escorted by staff|sexual harassment is reported to the crew|abusive passengers will be removed|insults and hate speech are forbidden|a man was fined for insulting the driver|threats against staff are reported to the police|obscene pictures must not be shown|please report offensive messages|we ban racist and sexist language|discrimination against disabled people is not tolerated|the police arrested a man who attacked a driver",
    "vi": "chó con|chó nhỏ|chó mèo phải nằm lồng|chó cảnh|con chó nhà mình ngoan|lợn quay|thịt bò|thịt chó mèo|bò kho|ngu ngơ|ngủ ngon|ngụ ở quê|ngư dân|nguồn điện|lộn xe|lồng chim|lồng chó|lòng tốt|lớn lên|buổi sáng|buổi tối|bưởi|buồn ngủ|các bạn|cắt tóc|cạc đà|đi đâu|địa điểm|đủ chỗ|đu quay|dù che mưa|đồ ăn|đồ đạc|đồ uống|đồ chơi|vú sữa|mông cổ|mông lung|liếm kem|cút kít|chim cút|chết máy|mệt chết đi được|nóng chết|buồn cười|điên đảo|mê điên|thằng bé|thằng em|thằng cu nhà mình|con bé|bọn mình|bọn trẻ|tụi mình|tụi nhỏ|lũ trẻ|lũ bạn|lũ lụt|đánh răng|đánh giá|đập nước|bắn pháo hoa|chém gió|đốt nhang|rác|thùng rác|bỏ rác đúng chỗ|bẩn tay|hôi xăng|ngu dại tuổi trẻ|dâm bụt|làm tình nguyện|giới tính ghi trên vé|tình dục học đường|quấy rối tình dục trên xe phải báo ngay|cấm chửi bới xúc phạm nhân viên|khách đe dọa tài xế bị mời xuống|đã phạt một người chửi nhân viên|cấm ngôn từ thù ghét|không phân biệt đối xử với người khuyết tật|nội dung khiêu dâm bị xóa|báo cáo lời lẽ tục tĩu|công an bắt kẻ đánh tài xế|tao nhã|lễ tao đàn|mày mò|mày râu|cặp vé|cặp sách|phò mã|đĩa nhạc|điếm canh|mẹ mình|mẹ con|bố mẹ|bà mẹ trẻ|má ơi|ông bà",
    "ja": "死ぬほど眠い|死にそうなくらい暑い|必死に走った|殺風景|殺到する|殺菌済み|クズ野菜|くず餅|葛の花|カステラ|カスタード|ゴミ箱|ゴミの分別|生ゴミ|馬鹿にならない値段|馬と鹿|アホウドリ|豚肉|豚丼|豚汁|子豚|デブリ|ブスッと|猫に引っかかれた|ビッチリ|セックス欄ではなく性別欄|性別と年齢|エッチング|エロス像|おっぱい山|胸がいっぱい|尻尾|尻もち|目尻|裸足|裸眼|全裸足型|変態する昆虫|寄生虫検査|害虫駆除|獣医|獣道|移民の歴史|外国人登録|女性専用車両|老人ホーム|障害者割引|障害物|頭が痛い|頭を下げる|気持ち悪くなって薬を飲んだ|気分が悪い|黙って乗る|静かに消える|出て行く便|売店|春を売り出す|援助|強風|性能|性格|くそまじめ|畜産|糞の始末は飼い主が|車内での嫌がらせは係員へ|暴言や脅しはお断りします|卑猥な画像は禁止です|差別的な言葉は削除します|運転手を殴った男が逮捕されました|侮辱した乗客に罰金|迷惑行為の報告|いじめ防止|殴られた乗務員の報告|死亡事故の案内|消えろと落書きされた掲示の撤去|豪雨で潰れた橋|お前立ち|貴様の字の読み方",
    "zh": "操作简单|操场|体操|早操|草地|草莓|日程|干净|干粮|妈妈的票|他妈妈|你妈妈|马上|尼泊尔|逼近|逼真|傻傻分不清|笨重|笨手笨脚地收拾|蠢蠢欲动|猪肉|猪排|小猪|狗粮|狗绳|导盲犬|热狗|鸡蛋|鸡肉|鸡腿|鸭子|屁股坐疼了|放屁虫|奶茶|牛奶|胸口|胸针|垃圾桶|垃圾分类|废物利用|神经科|残疾人通道|残疾证|老人优先|老头乐|白痴症研究|混合|混凝土|滚动屏|滚烫|翻滚|闭嘴笑|去世|去死海旅游|找死角|打死结|累死了|困死了|热死了|笑死我了|饿死了|杀菌|杀价|杀到车站|砍价|砍柴|捅马蜂窝|打飞机票电话|打断一下|打烂的杯子|揍敌客漫画|小姐姐|小姐您好|陪护|包车|过夜的酒店|做爱心早餐|性别|性能|性价比|色彩|黄色|黄色座位|黄片糖|裸眼|脱鞋|脱衣服过安检|变态辣|寄生虫检查|害虫防治|畜牧|禽蛋|外地人办证|外国旅客|移民局|女士车厢|同性朋友|黑人牙膏|骗子提醒|骚扰电话|性骚扰请报告|辱骂乘务员会被请下车|禁止色情内容|仇恨言论会删除|有人打司机被拘留|威胁员工要报警|不许歧视残疾人|侮辱他人罚款通知",
}

# Whole sentences, abusive, hateful or explicit:
ABUSIVE = {
    "en": [
        "fuck you and your bus", "only an asshole would charge that", "honestly whoever runs this is a lying dickhead", "I will smash your face in, you little bitch",
        "I am going to kill you", "these crooks deserve to be shot", "foreigners are parasites, throw them off the plane", "those people are an inferior race of vermin",
        "gays are disgusting and should be locked up", "looking for a hot blowjob near the station", "the girl in seat has a great ass, I want to lick it", "wanna have sex tonight, horny girls call me",
        "suck my dick, whore", "you are a fat ugly slut and a retard", "go kill yourself you loser", "motherfucking cunts, the lot of you", "what an idiot driver", "this shitty company",
        "bullshit, you damn liars", "filthy pig of a conductor", "next time you are late I will break your legs", "I will punch the ticket clerk", "your mother is a whore",
        "hookers for the night, cheap escorts", "foreigners are vermin and should be thrown off the bus", "I will smash your teeth in if it is late again",
    ],
    "vi": [
        "đm nhà xe lừa đảo", "lũ chó má ăn tiền rồi im", "con nhỏ mông ngon, muốn bú liếm quá", "địt mẹ chờ lâu", "dân ở đó toàn một giống hạ đẳng", "vãi lồn cái xe này",
        "đụ má tụi bây", "mày là thằng chó đẻ", "tao giết hết chúng mày", "bọn tàn tật là gánh nặng, đừng cho lên xe", "con đĩ này câm mồm", "đồ lừa đảo khốn kiếp", "thằng ngu này lái xe như cứt",
        "cặc, mất toi tiền", "xem phim sex trên xe rồi thủ dâm", "cho anh xem lồn em đi", "lần sau trễ nữa tao chặt chân mày", "bọn đồng tính bệnh hoạn nên nhốt lại", "đồ súc vật",
        "cút mẹ mày đi", "vãi lồn cái tàu này", "địt mẹ chờ cả mấy tiếng", "địt mẹ, đợi mãi", "đồ mặt dày, chết mẹ mày đi",
    ],
    "ja": [
        "くそったれの会社め、ふざけんな", "おっぱい見せてくれたら払う", "乗務員の尻を舐めたい", "車内でエロ動画を見てオナニーした", "外国人は寄生虫だ、追い出せ", "お前の母ちゃん売春婦", "ぶっ殺すぞ、この野郎", "次に遅れたら足をへし折るぞ", "あの地方の人間は劣等種だ", "やらせろよ、このビッチ", "駅の近くで風俗嬢を探してる",
        "バカか、死ねよ", "クソ会社、潰れろ", "ブスの窓口係は引っ込め", "気持ち悪いホモは乗るな", "席でオナニーしてた", "外国人は害虫だから追い出せ",
    ],
    "zh": [
        "给我摸摸奶子，加钱", "操你妈的航空", "外地人都是害虫，滚出去", "车上看黄片打飞机", "找个小姐过夜，车站附近", "在座位上看黄片打飞机", "我要杀了你全家", "同性恋真恶心，应该关起来", "婊子养的售票员", "外国人都是寄生虫，赶下飞机", "那里的人都是劣等民族", "他妈的什么破车", "约炮吗，宝贝，鸡巴好大", "臭婊子闭嘴",
        "王八蛋，还钱", "我一拳打烂售票员的嘴", "傻子，白痴，废物司机",
    ],
}
# Whole sentences that are not, among them words that only look alike, and rules and reports:
CLEAN = {
    "en": [
        "My cocker spaniel slept in her crate the whole trip", "The hell of a queue moved faster than feared", "There was free water and a shiitake soup at the canteen",
        "The new terminal has an assistance desk", "I took the night train and the driver waited in the rain", "Anything above the allowance costs extra", "Hate speech and insults are not tolerated on our trains",
        "A passenger was fined for insulting the conductor", "Please report abusive or obscene messages to us", "The assassin in the film takes a train to Scunthorpe and Sussex",
        "The dickens of a delay, but the staff were kind", "Pussy willow and titmice along the line", "Classic bass music in the passage", "Old people and the disabled board first",
        "Women may book the ladies compartment", "Foreigners need a passport to board", "my dog is dumb but lovely", "the wait was killing me", "naive cafe", "good screw tops on the bottles",
        "the seat was damaged", "the price was fair for so many stops", "my aunt went to buy bread at the rest stop", "since my cousin came along I picked the sleeper",
        "next time I will take the earlier service to avoid the crowd", "the second driver kept praising the luggage desk", "there are several departures a day through this town",
        "the seat map locks before it leaves", "cats and dogs travel in a closed crate", "the hall was noisy but clean", "minors who ride alone need a form signed by whoever meets them",
        "if the scanner fails staff can type in the code by hand", "to change your number sign out of the other devices first", "groups should call first so that we can seat them together",
        "the app said late but we came in early", "can I lick the ice cream on board", "the night was dead quiet", "I was dying for a coffee", "shot of espresso at the bar",
        "The staff were kind, though the fan was noisy", "Paying that much for the stops felt fair",
    ],
    "vi": [
        "Con chó nhà mình nằm ngoan trong lồng suốt chặng", "thằng em út xuống mua bánh mì", "Người già và người khuyết tật được lên trước", "Phụ nữ mang thai ngồi ghế đầu",
        "Nội dung khiêu dâm và lời lẽ thù ghét bị cấm trên xe", "Đã xử phạt hành khách xúc phạm nhân viên", "Mèo và chó phải nằm trong lồng kín có lót thấm khi đi tàu",
        "Mẹ mình đi cùng nên chọn xe giường nằm", "Đồ ăn sáng cũng tạm", "Đồ đạc để quên trên xe giữ lại một tuần", "Người nước ngoài cần hộ chiếu", "Lũ trẻ ngủ say trên tàu",
        "bọn mình đi chung một đoàn", "đợi chết đi được mà vẫn vui", "tao nhã, lịch sự", "nếu ghế đừng chật như vậy thì mình cho năm sao", "nhân viên nói năng nhẹ nhàng, quạt hơi ồn",
        "giá như vậy là hợp lý", "nếu màn hình đừng mờ như vậy thì mình cho năm sao", "lần sau mình đặt chuyến khác cho đỡ đông", "lúc tới nơi thì phòng chờ mát hẳn ra",
        "đi với bà nên mình đặt xe giường nằm cho tiện", "mang vali lên xe có bị tính thêm tiền không", "chuyến chạy trễ vì mưa lớn", "hủy sát giờ sẽ mất tiền vé", "còn ghế cạnh cửa sổ không",
        "bác tài vẫn chờ thêm dưới mưa", "bảng giá ồn ào, tấm chăn rối",
    ],
    "ja": [
        "手数料も馬鹿にならない金額です", "連休は窓口に客が殺到して、何時間も並びました", "うちの犬はケージの中でおとなしくしていました", "ご高齢の方と障害のある方からご乗車ください", "女性専用車両があります", "外国人のお客様は旅券をお持ちください", "差別的な発言や卑猥な画像は禁止です", "迷惑行為の報告を受け、警察に通報しました",
        "荷物が重くて死にそうでしたが手伝ってもらえました", "豚肉を使わないお弁当もあります", "馬に乗れる牧場と鹿の公園", "頭が痛くなったので薬をもらいました", "やばいくらい美味しい駅弁", "殺風景な待合室", "くそまじめな運転手さん", "雨の中でも運転手さんが待ってくれました", "息子が一人で行けますか", "番号の席は窓側です",
        "次の便にして混雑を避けようと思います", "お一人様のお荷物は合計二十キロまで", "この値段なら納得です",
    ],
    "zh": [
        "我家狗狗一路都乖乖待在笼子里", "老人和残疾人优先上车", "女士可以订女性车厢", "外国旅客请带护照", "禁止发布色情和仇恨言论", "有人骂人已经报警处理", "操作很简单，在体操馆旁边", "猪肉便当卖完了", "困死了，但是赶上了换乘", "杀到车站排队的人很多", "蠢蠢欲动的小狗", "傻傻分不清两个站", "滚动显示屏看不清",
        "屁股坐疼了，座位有点硬", "鸡蛋和鸭子", "小姐姐很热情地帮忙", "我儿子能一个人去吗", "破旧但是干净的车站", "下着雨司机还多等了几分钟", "机器扫不出来时工作人员会手动输入", "说实话显示屏比去年吵", "下次我订早一点的那班，人少一点", "孩子独自坐车时需要接站人的签字", "在休息站下车买了面包", "带箱子上车要加钱吗",
        "一直夸毛毯和早餐",
    ],
}


def _filled(frames: list[str], place: str, words: list[str]) -> list[str]:
    return [f.replace(place, w) for f in frames for w in (words if place in f else words[:1])]


def abusive() -> dict[str, tuple[list[str], list[str]]]:
    """Per language: (words and phrases, sentences)."""
    out = {}
    for lang in WORDS:
        gap = " " if lang in ("en", "vi") else ""
        hate = [f"{g}{gap}{h}" for g, h in itertools.product(GROUPS[lang], HATE[lang])]
        out[lang] = (WORDS[lang].split("|"), hate + _filled(THREATS[lang], "{p}", PARTS[lang]) + _filled(SEXUAL[lang], "{b}", BODY[lang]))
    return out


def clean() -> dict[str, list[str]]:
    """Per language: ordinary statements in the same frames, look-alikes, rules and reports."""
    out = {}
    for lang in WORDS:
        gap = " " if lang in ("en", "vi") else ""
        fair = [f"{g}{gap}{h}" for g, h in itertools.product(GROUPS[lang], FAIR[lang])]
        out[lang] = _filled(SAID[lang], "{t}", THINGS[lang]) + fair + ALIKE[lang].split("|")
    return out
