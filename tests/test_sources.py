import struct

import numpy as np
import pytest

from raylattice.sources import formats, scanners
from raylattice.streaming import incremental


def xim_bytes(image, props):
    h, w = image.shape
    flat = image.ravel().astype(int)
    head = struct.pack("<8s6i", b"VMS.XI\0\0", 1, w, h, 32, 4, 1)
    sizes, body = [], b""
    for i in range(w + 1, h * w):
        d = int(flat[i] - flat[i - 1] - flat[i - w] + flat[i - w - 1])
        code = 0 if -128 <= d < 128 else 1 if -32768 <= d < 32768 else 2
        sizes.append(code)
        body += struct.pack("<" + "bhi"[code], d)
    sizes += [0] * (-len(sizes) % 4)
    table = bytes(sum(c << 2 * j for j, c in enumerate(sizes[k : k + 4])) for k in range(0, len(sizes), 4))
    data = struct.pack(f"<{w + 1}i", *flat[: w + 1]) + body
    out = head + struct.pack("<i", len(table)) + table + struct.pack("<i", len(data)) + data + struct.pack("<i", 4 * w * h) + struct.pack("<i", 0) + struct.pack("<i", len(props))
    for k, v in props.items():
        out += struct.pack("<i", len(k)) + k.encode() + (struct.pack("<id", 1, v) if isinstance(v, float) else struct.pack("<ii", 2, len(v)) + v.encode())
    return out


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    for dtype in ("<u1", "<u2", ">u2", "<f4"):
        image = (rng.random((5, 7)) * 200).astype(dtype)
        assert (formats.tiff(formats.tiff_bytes(image)) == image).all()
    with pytest.raises(ValueError):
        formats.tiff(b"nope")
    image = rng.integers(-5, 5, (6, 9)).cumsum(1) + rng.integers(0, 2, (6, 9)) * 40_000
    got, props = formats.xim(xim_bytes(image, {"GantryRtn": 12.5, "Note": "x"}))
    assert (got == image).all() and props == {"GantryRtn": 12.5, "Note": "x"}
    volume = rng.integers(0, 99, (2, 3, 4)).astype("<i2")
    got, header = formats.meta_image(b"NDims = 3\nDimSize = 4 3 2\nElementType = MET_SHORT\nElementDataFile = LOCAL\n" + volume.tobytes())
    assert (got == volume).all() and header["NDims"] == "3"
    assert formats.xml_values("<a:R xmlns:a='u'><a:P v='1'> 5 </a:P></a:R>") == {"R/P@v": "1", "R/P": "5"}


def test_folders(spark, tmp_path):
    image = np.full((3, 4), 1000, "<u2")
    for k in range(6):
        (tmp_path / f"f{k}.tif").write_bytes(formats.tiff_bytes(image + k))
    (tmp_path / "s.xtekct").write_text(
        "[XTekCT]\nVoxelsX=4\nVoxelsY=4\nVoxelsZ=3\nVoxelSizeX=1\nVoxelSizeY=1\nVoxelSizeZ=1\nDetectorPixelsX=4\nDetectorPixelsY=3\nDetectorPixelSizeX=0.5\nDetectorPixelSizeY=0.5\nSrcToObject=100\nSrcToDetector=200\nProjections=6\nAngularStep=60\nInitialAngle=0\nWhiteLevel=2000\n"
    )
    images, g, angles = scanners.nikon(spark, str(tmp_path), "step", 2)
    rows = images.orderBy("proj_idx").collect()
    assert [r["proj_idx"] for r in rows] == [0, 2, 4] and g.n_detector == (3, 4) and angles.count() == 3
    assert rows[1]["data"] == pytest.approx(np.full(12, -np.log(1002 / 2000)))
    assert scanners.nikon(spark, str(tmp_path), "equidistant", 3)[0].count() == 3
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "h.txt").write_text("Number of Detector Elements\t3\nCT: Number of Projections\t2\n2D-Pixel Size [mm]\t0,4\nNumber of Z-slices\t3\nFOD [mm]\t100\nFDD [mm]\t200\nImage Dimension\t3\n")
    (raw / "p0.raw").write_bytes(np.arange(1, 10, dtype="<u2").tobytes())
    images, g, _ = scanners.yxlon(spark, str(raw))
    assert g.dsd == 200 and images.first()["data"][0] == pytest.approx(-np.log(7 / 65535))
    frames = tmp_path / "xim"
    frames.mkdir()
    for k, a in enumerate((0.0, 0.4, 1.1, 1.2, 2.5)):
        (frames / f"Proj_{k}.xim").write_bytes(xim_bytes(np.arange(12).reshape(3, 4), {"GantryRtn": a, "KVNormChamber": 2.0}))
    kept = scanners.varian_projections(spark, str(frames), 1.0).orderBy("idx").collect()
    assert [r["angle"] for r in kept] == [90.0, 91.1, 92.5]
    assert kept[0]["data"] == (np.arange(12).reshape(3, 4)[:, ::-1] / 2.0).ravel().tolist()
    with pytest.raises(FileNotFoundError):
        scanners.text_of(spark, f"{tmp_path}/*.tif")


def test_nikon_angles_as_recorded(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.tif").write_bytes(formats.tiff_bytes(np.full((3, 4), 1000, "<u2")))
    (tmp_path / "s.xtekct").write_text(
        "[XTekCT]\nVoxelsX=4\nVoxelsY=4\nVoxelsZ=3\nVoxelSizeX=1\nVoxelSizeY=1\nVoxelSizeZ=1\nDetectorPixelsX=4\nDetectorPixelsY=3\nDetectorPixelSizeX=0.5\nDetectorPixelSizeY=0.5\nSrcToObject=100\nSrcToDetector=200\nProjections=3\nAngularStep=60\nInitialAngle=0\nWhiteLevel=2000\n"
    )

    def angles(*sampling):
        return {r["idx"]: round(np.degrees(r["angle"]), 9) for r in scanners.nikon(spark, str(tmp_path), *sampling)[2].collect()}

    assert angles() == {0: 0.0, 1: -60.0, 2: -120.0}
    (tmp_path / "s_ctdata.txt").write_text("Projs\tFrames\n3\t1\nProjection\tAngle(deg)\tTime(s)\n1\t0.5\t1\n3\t100.25\t3\n2\t61\t2\n")
    assert angles() == {0: -0.5, 1: -61.0, 2: -100.25} and angles("step", 2) == {0: -0.5, 2: -100.25}
    ang = tmp_path / "s.ang"
    for line in ("{}:\t{}\n", "{}\t{}\n", "{}: {}\n"):
        ang.write_text("Proj\tAngle(deg)\n" + "".join(line.format(k + 1, a) for k, a in enumerate((1, 2.5, 7))))
        assert angles() == {0: 1.0, 1: 2.5, 2: 7.0}
    ang.write_text("Proj\tAngle(deg)\n1\t1\n2\t2\n")
    with pytest.raises(ValueError):
        angles()


def test_stream_equals_batch(spark, tmp_path):
    from raylattice import geometry as G
    from raylattice.operators.fields import Field, Projector

    g = G.Geometry((2, 3, 3), (2.0, 3.0, 3.0), (3, 4), (1.0, 1.0), 50.0, 80.0)
    a = Projector(g, G.views(spark, g, [0.0, 1.0, 2.0, 3.0]))
    b = a.forward(a.ones(True))
    views = a.views.join(b.df.withColumnRenamed("k", "proj_idx"), "proj_idx")
    path = str(tmp_path / "views")
    views.repartition(4, "proj_idx").write.parquet(path)
    stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = incremental.running_volume(stream, g).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["cell"]: r["value"] for r in spark.table("running").collect()}
    expected = a.adjoint(Field(b.df), "fdk").array().ravel()
    assert [got.get(i, 0.0) for i in range(18)] == pytest.approx(expected)


def test_spaced_stream_keeps_its_state(spark, tmp_path):
    schema = "scan_id bigint, idx bigint, angle double"
    for k, rows in enumerate(([(1, 0, 0.0), (1, 1, 0.5)], [(1, 2, 1.2), (2, 0, 5.0), (1, 3, 1.3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "v" / f"p={k}"))
    stream = spark.readStream.schema(schema + ", p int").parquet(str(tmp_path / "v"))
    q = incremental.spaced_stream(stream, 1.0).writeStream.format("memory").queryName("spaced").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("spaced").collect())) == [(1, 0, 0.0), (1, 2, 1.2), (2, 0, 5.0)]


SCAN_XML = (
    '<Scan xmlns="http://baltic.varian.com" Version="{version}"><Acquisitions><SID>1500</SID><SAD>1000</SAD><ImagerSizeX>12</ImagerSizeX><ImagerSizeY>3</ImagerSizeY><ImagerResX>2</ImagerResX><ImagerResY>2</ImagerResY>'
    "<ImagerLat>-4</ImagerLat><StartAngle>0</StartAngle><StopAngle>30</StopAngle><Bowtie>{bowtie}</Bowtie><Velocity>6</Velocity><FrameRate>1</FrameRate></Acquisitions></Scan>"
)


def varian_folder(at, version="2.7.0.0", bowtie="Half"):
    """Six frames of which two come too early, two blanks, a broken file."""
    rng = np.random.default_rng(4)
    (at / "Acquisitions/77").mkdir(parents=True)
    (at / "Calibrations/Air-1/Current").mkdir(parents=True)
    (at / "Scan.xml").write_text(SCAN_XML.format(version=version, bowtie=bowtie))
    frames = {}
    for k, angle in enumerate((0.0, 1.0, 6.0, 8.0, 12.0, 350.0)):
        frames[angle] = rng.integers(100, 1000, (3, 12))
        (at / f"Acquisitions/77/Proj_{k}.xim").write_bytes(xim_bytes(frames[angle], {"GantryRtn": angle, "KVNormChamber": 2.0 + k}))
    (at / "Acquisitions/77/Proj_9.xim").write_bytes(b"broken")
    blanks = {a: np.full((3, 12), 40_000 + 100 * int(a)) for a in (0.0, 20.0)}
    for k, (a, image) in enumerate(blanks.items()):
        (at / f"Calibrations/Air-1/Current/FilterBowtie_CC{k}.xim").write_bytes(xim_bytes(image, {"GantryRtn": a, "KVNormChamber": 4.0}))
    (at / "Calibrations/Air-1/Current/Filter.xim").write_bytes(xim_bytes(blanks[0.0], {"GantryRtn": 0.0, "KVNormChamber": 4.0}))
    return frames, blanks


def test_varian_folder_from_frames_to_line_integrals(spark, tmp_path):
    frames, blanks = varian_folder(tmp_path)
    images, g, angles = scanners.varian(spark, str(tmp_path))
    assert (g.n_detector, g.d_detector, g.dso, g.dsd, g.off_detector) == ((3, 12), (2.0, 2.0), 1000.0, 1500.0, (0.0, 4.0)) and g.n_voxel == (3, 14, 14)
    at = {r["idx"]: np.degrees(r["angle"]) for r in angles.collect()}
    assert at == pytest.approx({0: 90.0, 2: 96.0, 4: 102.0, 5: 440.0})
    got = {r["proj_idx"]: np.array(r["data"]).reshape(3, 12) for r in images.collect()}
    for k, a in zip((0, 2, 4, 5), (0.0, 6.0, 12.0, 350.0), strict=True):
        share = {0.0: 0.0, 6.0: 0.3, 12.0: 0.6, 350.0: 10 / 340}[a]
        blank = ((1 - share) * blanks[0.0] + share * blanks[20.0]) / 4
        lines = np.log(np.maximum(1, blank / (frames[a][:, ::-1] / (2.0 + k))))
        wide = np.pad(lines, [(0, 0), (4, 4)], mode="symmetric")
        assert got[k] == pytest.approx(np.median([wide[:, j : j + 12] for j in range(9)], axis=0), rel=1e-9)
    assert scanners.varian(spark, str(tmp_path), spaced=False)[2].count() == 6
    with_scatter = scanners.varian(spark, str(tmp_path), point=[1.0, 0.3, 0.2, 0.1, 1.0, 0.04])[0]
    assert with_scatter.count() == 4
    (tmp_path / "Reconstruction.xml").write_text("<R><VOISizeX>40</VOISizeX><VOISizeY>40</VOISizeY><VOISizeZ>9</VOISizeZ><MatrixSize>20</MatrixSize><SliceThickness>2</SliceThickness></R>")
    assert scanners.varian_settings(spark, str(tmp_path))[1].n_voxel == (5, 20, 20)


def test_older_varian_folders_have_one_blank_and_unknown_ones_are_refused(spark, tmp_path):
    frames, blanks = varian_folder(tmp_path / "old", "2.0", "None")
    images, _, _ = scanners.varian(spark, str(tmp_path / "old"))
    first = np.array(images.where("proj_idx = 0").first()["data"]).reshape(3, 12)
    lines = np.pad(np.log(blanks[0.0] / 4 / (frames[0.0][:, ::-1] / 2.0)), [(0, 0), (4, 4)], mode="symmetric")
    assert first == pytest.approx(np.median([lines[:, j : j + 12] for j in range(9)], axis=0), rel=1e-9)
    varian_folder(tmp_path / "new", "3.1")
    with pytest.raises(ValueError, match="unknown version"):
        scanners.varian(spark, str(tmp_path / "new"))


LOG = "[System]\nCamera Pixel Size (um)=50\n[Acquisition]\nNumber of Files=4\nNumber of Rows=3\nNumber of Columns=4\nCamera binning=2x2\nOptical Axis (line)=2\nImage Pixel Size (um)=20\nObject to Source (mm)=100\nCamera to Source (mm)=200\nRotation Step (deg)=30\nDepth (bits)=12\n"


def test_bruker_shifts_white_level_and_connected_scans(spark, tmp_path):
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    many.mkdir()
    for k in range(4):
        (one / f"f{k:04d}.tif").write_bytes(formats.tiff_bytes(np.full((3, 4), 1000 + k, "<u2")))
    (one / "s.log").write_text(LOG)
    images, g, angles = scanners.bruker(spark, str(one))
    assert images.count() == 3 and g.d_detector == (0.1, 0.1) and g.off_detector == (pytest.approx(0.05), 0.0) and g.d_voxel[0] == pytest.approx(0.02)
    assert images.where("proj_idx = 1").first()["data"] == pytest.approx([-np.log(1001 / 4096)] * 12) and angles.columns == ["idx", "angle"]
    (one / "s.csv").write_text("a\nb\nc\nd\ne\n0,1.5,2\n1,-1,0\n2,0,0\n")
    shifted = {r["idx"]: (r["off_v"], r["off_u"]) for r in scanners.bruker(spark, str(one))[2].collect()}
    assert shifted == {0: pytest.approx((0.15, 0.075)), 1: pytest.approx((0.05, -0.05)), 2: pytest.approx((0.05, 0.0))}
    for scan in range(2):
        (many / f"s{scan:02d}.log").write_text(LOG)
        for k in range(4):
            (many / f"s{scan:02d}{k:08d}.tif").write_bytes(formats.tiff_bytes(np.full((3, 4), 1000 + 10 * scan + k, "<u2")))
    with pytest.raises(ValueError, match="choose one"):
        scanners.bruker(spark, str(many))
    with pytest.raises(ValueError, match="no scan"):
        scanners.bruker(spark, str(many), dataset=5)
    second = scanners.bruker(spark, str(many), dataset=1)[0]
    assert second.where("proj_idx = 0").first()["data"][0] == pytest.approx(-np.log(1010 / 4096))
    images, _, angles = scanners.bruker(spark, str(many), dataset="all")
    assert sorted(r["proj_idx"] for r in images.collect()) == sorted(r["idx"] for r in angles.collect()) == list(range(6))


def test_yxlon_with_an_xml_header(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.tif").write_bytes(formats.tiff_bytes(np.full((3, 4), 500 + k, "<u2")))
    body = '<P xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><ConeBeamScanParameter><PixelSize><Height>0.4</Height><Width>0.2</Width></PixelSize><ProjectionSize><Height>3</Height><Width>4</Width></ProjectionSize><ProjectionBitdepth>16</ProjectionBitdepth><ScanTrajectory xsi:type="{}"><PixelPitch>0.5</PixelPitch><Fdd>800</Fdd><Fod>400</Fod><YoCenter>2</YoCenter><NumberOfProjections>2</NumberOfProjections><StartAngle>90</StartAngle><Rotation>360</Rotation></ScanTrajectory><DejustmentParameter><HorizontalDetectorOffset>4</HorizontalDetectorOffset><VerticalDetectorOffset>6</VerticalDetectorOffset></DejustmentParameter></ConeBeamScanParameter></P>'
    (tmp_path / "ScanParameter.xml").write_text(body.format("CircleTrajectory"))
    images, g, angles = scanners.yxlon(spark, str(tmp_path))
    assert (g.dsd, g.dso, g.cor, g.off_detector, g.n_detector, g.d_detector) == (400.0, 200.0, -1.0, (-3.0, -2.0), (3, 4), (0.4, 0.2))
    assert {r["idx"]: r["angle"] for r in angles.collect()} == pytest.approx({0: np.pi / 2, 1: -np.pi / 2})
    assert images.where("proj_idx = 1").first()["data"] == pytest.approx([-np.log(501 / 65535)] * 12)
    (tmp_path / "ScanParameter.xml").write_text(body.format("HelixTrajectory"))
    with pytest.raises(ValueError, match="circular"):
        scanners.yxlon(spark, str(tmp_path))
