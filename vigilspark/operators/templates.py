"""Templates, slots and frames of synthesised messages: school and family life as we imagine it, with what a swindler might write among it."""

from __future__ import annotations

#: (label, category, text with slots)
TEMPLATES = [
    (0, "SAFE", "Câu lạc bộ robot dời buổi tập sang {weekday} lúc {hour}, {name} báo giúp các bạn."),
    (0, "SAFE", "Bố vừa thay xích xe đạp, chiều con tự đạp đi học được rồi."),
    (0, "SAFE", "Thư viện mở tới {hour}, ai mượn sách giáo khoa {subject} thì trả trước {weekday}."),
    (0, "SAFE", "Lớp {grade} mang theo vở bài tập {subject}, tiết {n} chữa phần hình vẽ."),
    (0, "SAFE", "Chị ơi tối nay nhà mình ăn cơm lúc {hour}, chị mua thêm bó rau muống."),
    (0, "SAFE", "Đề cương ôn tập {subject} nằm trên https://hocmai.vn, cả tổ in ra đọc."),
    (0, "SAFE", "cuoi tuan lop minh da bong voi lop {grade}, {name} lo phan nuoc uong"),
    (0, "SAFE", "Xe buýt số {n} đến muộn vì kẹt cầu, các em đợi ở {place}."),
    (0, "SAFE", "BIDV: OTP của quý khách là 7{n}40{n}2, không cung cấp mã này cho bất kỳ ai."),
    (0, "SAFE", "Quý khách còn {n}GB trong gói cước tháng này, chi tiết liên hệ 18001091."),
    (0, "SAFE", "Ông nội hỏi bao giờ con về quê, vườn ổi chín nhiều lắm."),
    (0, "SAFE", "Thứ tư sinh nhật {friend}, cả bàn góp bánh nha"),
    (0, "SAFE", "Thời khóa biểu mới dán ở {place}, {subject} chuyển sang tiết {n}."),
    (0, "SAFE", "Em nộp ảnh thí nghiệm {subject} của nhóm {n} ạ"),
    (0, "SAFE", "Con để quên áo khoác ở {place}, bác bảo vệ giữ giùm rồi."),
    (0, "SAFE", "Trực nhật lớp {grade} tuần này: {name} và {friend}."),
    (0, "SAFE", "Bài kiểm tra {subject} có {n} câu vẽ đồ thị, ai thiếu thước kẻ thì hỏi {friend}."),
    (0, "SAFE", "Bà ngủ sớm rồi, về tới nhà thì khóa cửa bếp, con mèo đang ở sân sau."),
    (0, "SAFE", "Danh sách hợp xướng gửi về {name}@hopca.example.vn hoặc gọi {phone} 😀"),
    (0, "SAFE", "Trạm y tế cân đo lớp {grade} vào {weekday}, chỗ {place}."),
    (1, "SUSPICIOUS_INVITE", "Ai mê phim câm thì vào nhóm này: https://zalo.me/g/{name}{n}"),
    (1, "SUSPICIOUS_INVITE", "Tham gia server câu cá của bọn mình, toàn người chưa gặp, hỏi {phone}"),
    (1, "SUSPICIOUS_INVITE", "Vòng quay may mắn ở {shop}, quay thử một lượt xem ra gì."),
    (1, "SUSPICIOUS_INVITE", "Minigame đoán tỉ số, để lại số điện thoại {phone} là có huy hiệu {club}"),
    (1, "SUSPICIOUS_INVITE", "Cho mình xin zalo của {name} để rủ vào đội {club}."),
    (1, "SUSPICIOUS_INVITE", "Mời bạn dùng thử ứng dụng luyện {subject}, tặng khóa học {n} buổi."),
    (1, "SUSPICIOUS_INVITE", "Đăng ký ngay lớp đàn tranh ở {shop}, tài liệu miễn phí cho ai đến sớm."),
    (1, "SUSPICIOUS_INVITE", "Nhóm chat mới của khối {grade}, mở thử http://{odd}/khoi"),
    (1, "SUSPICIOUS_INVITE", "Gửi thông tin của bạn cho {shop} để giữ chỗ trại hè ở {place}."),
    (1, "SUSPICIOUS_INVITE", "moi ban tham gia doi {club}, phi thanh vien tinh sau"),
    (1, "ADS_SPAM", "{shop} giảm giá {n}0% vở kẻ ngang, inbox để đặt hàng."),
    (1, "ADS_SPAM", "Xả kho ba lô vải bạt, chỉ từ {n}9k, ghé {shop} trước {weekday}."),
    (1, "ADS_SPAM", "Sale giày leo núi, nhắn tin để được tư vấn, số {phone}"),
    (1, "ADS_SPAM", "Mình bán tài khoản game nông trại cấp {n}0, hỏi {friend}."),
    (1, "ADS_SPAM", "Khuyến mãi chè bưởi {shop}: mua {n} tặng một, tới hết {weekday}."),
    (1, "ADS_SPAM", "Nhượng lại acc nuôi cá cảnh, giá rẻ cho bạn nào học {grade}."),
    (1, "PHISHING_LINK", "Bản đồ trại hè {club} có ở http://{odd}/ban-do.apk"),
    (1, "PHISHING_LINK", "Bảng điểm {subject} có rồi, xem http://{odd}/diem?lop={grade}"),
    (1, "PHISHING_LINK", "Truy cập {odd} để bình chọn cho tiết mục của {name}."),
    (1, "PHISHING_LINK", "Nhấn vào đường dẫn {odd} xem ai được giải vẽ tranh."),
    (1, "IMPERSONATION_RELATIVE", "Tớ là {friend} bạn hồi mẫu giáo, nick chính mất rồi nên dùng máy này."),
    (1, "IMPERSONATION_TEACHER", "Trợ lý của thầy {teacher} xin danh sách lớp {grade}."),
    (2, "IMPERSONATION_TEACHER", "Thầy {teacher} dạy {subject} đây, thầy kẹt ở bến phà, mua giúp thầy {n} thẻ Viettel {amount}, chiều thầy trả lại."),
    (2, "IMPERSONATION_TEACHER", "Cô {teacher} là GVCN lớp {grade}, em chuyển khoản {amount} quỹ trại hè vào số tài khoản {account}."),
    (2, "IMPERSONATION_TEACHER", "Phòng kế toán thu {amount} tiền thẻ thư viện, đóng phí trước {hour} qua momo {phone}"),
    (2, "IMPERSONATION_TEACHER", "Ban giám hiệu yêu cầu lớp {grade} nộp {amount} tiền rèm cửa vào tài khoản {account}"),
    (2, "IMPERSONATION_RELATIVE", "Bác {name} đây, máy bác rơi xuống ao, số mới của bác, chuyển gấp {amount} tiền thuốc."),
    (2, "IMPERSONATION_RELATIVE", "Anh {friend} đây, anh hết xăng giữa đèo, cho vay tạm {amount}, mai anh trả."),
    (2, "IMPERSONATION_RELATIVE", "di day, con dung noi voi me, chuyen {amount} qua zalopay {phone} cho di"),
    (2, "IMPERSONATION_RELATIVE", "Nick cũ của tao bị hack, nạp giúp tao thẻ Garena {amount}"),
    (2, "OTP_PHISHING", "Tổng đài {shop}: đọc mã OTP vừa nhận để hủy đơn {amount}"),
    (2, "OTP_PHISHING", "Nhập mã xác minh ở https://{bad}/xn rồi lấy vé xem xiếc."),
    (2, "OTP_PHISHING", "Gửi mật khẩu trang lớp cho {name} chữa lỗi cột điểm {subject}."),
    (2, "OTP_PHISHING", "Cho mượn nick của {friend} một hôm, nhớ gửi cả pass."),
    (2, "ACCOUNT_THREAT", "Zalo của {name} bị khóa vĩnh viễn lúc {hour}, xác minh ngay ở https://{bad}/mo"),
    (2, "ACCOUNT_THREAT", "Có ảnh của {name} trốn trại, chuyển {amount} trước {hour} không thì đăng lên nhóm lớp."),
    (2, "ACCOUNT_THREAT", "Thiết bị lạ vừa vào ví, bấm vào đường dẫn https://{bad}/vi?ma={n} để bảo vệ tài khoản."),
    (2, "ACCOUNT_THREAT", "Đừng báo bố mẹ, cuốn băng trong tay tao, muốn lấy lại thì chuyển {amount}"),
    (2, "FAKE_PRIZE", "Số {phone} trúng giải xe đạp điện, nộp {amount} phí hồ sơ ở http://{bad}/giai"),
    (2, "FAKE_PRIZE", "{name} được bốc thăm trúng thưởng laptop của {shop}, đặt cọc {amount} giữ quà."),
    (2, "GAMBLING_SCAM", "Nổ hũ {club}, nạp {amount} nhận gấp đôi, vào http://{bad}"),
    (2, "GAMBLING_SCAM", "Cá cược chung kết kéo co lớp {grade}, nạp {amount} tặng x{n} trong {n}0 phút."),
    (2, "JOB_SCAM", "Việc nhẹ lương cao: like dạo buổi tối kiếm {amount}, đóng cọc trước."),
    (2, "JOB_SCAM", "Tuyển CTV gõ thơ, thu nhập {amount} mỗi ngày, chuyển phí hồ sơ vào {account}"),
    (2, "GAME_TOPUP_SCAM", "Nhận {n}00 quân huy free, nhập mã thẻ Viettel tại {bad}"),
    (2, "GAME_TOPUP_SCAM", "{shop} tặng skin Liên Quân, gửi mã thẻ {amount} kèm tên nick."),
    (2, "PHISHING_LINK", "Bưu kiện của {name} thiếu số nhà, cập nhật ở http://{bad}/buu-kien trong {n} giờ."),
    (2, "PHISHING_LINK", "Học bổng {amount} chờ bạn, điền đơn https://{bad}/hb?k={n} trước {hour}"),
]
#: What stands before and after a message; a text that ends in one of the fixed endings gets no closing words.
OPENERS = ["", "Báo tin: ", "", "Nghe này, ", "Tiện thể, ", ""]
CLOSERS = ["", " nhé.", "", " nha.", " cho kịp.", " ạ."]
SLOTS = {
    "name": ["Tú", "Vân", "Khoa", "Diệp", "Sơn", "Ngân", "Phúc"],
    "teacher": ["Lộc", "Hạnh", "Quyết", "Trâm"],
    "friend": ["Bin", "Mai", "Tèo", "Oanh", "Kiên"],
    "subject": ["Địa", "Sinh", "Nhạc", "Tin", "Vật lý"],
    "grade": ["6B", "7C", "8A", "9D", "10K"],
    "n": ["1", "2", "3", "4", "6", "9"],
    "hour": ["7h15", "11h", "16h40", "19h", "21h30"],
    "weekday": ["thứ ba", "thứ năm", "thứ bảy", "chủ nhật"],
    "place": ["nhà đa năng", "cổng sau", "phòng nhạc", "vườn trường"],
    "shop": ["Tiệm Lá", "Quán Bưởi", "Cửa hàng Ốc Sên", "Siêu thị Mây"],
    "club": ["Diều Giấy", "Sóng Nhỏ", "Cờ Vây", "Ong Vàng"],
    "amount": ["150k", "300k", "3 triệu", "700.000đ", "450k"],
    "account": ["60210098765", "0451000123789", "885200417733"],
    "phone": ["0368112704", "+84 35 811 2704", "039.771.5508"],
    "bad": ["the-game-re.vip", "vongquay-lua.club", "zalopay-hotro.online", "techcornbank.com", "is.gd/k7p", "10.1.4.9", "my.lazada-uudai.top", "zxkqwt.info"],
    "odd": ["172.16.8.3", "cutt.ly", "bcdfghk.net", "vuonrau.example.org", "tiemhoa.shop", "olm.vn", "gareena.com", "shopee-freeship.xyz/cai.apk"],
}
